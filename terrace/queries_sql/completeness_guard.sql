-- How many objects does each vendor map?
SELECT namespace(m.term) AS vendor, count(DISTINCT o.obj) AS mapped_objects
FROM {below_ref_DataObject} o
JOIN {matches} m ON m.obj = o.obj
GROUP BY vendor
ORDER BY vendor
