-- How many reference objects do two vendors both map?
WITH mapped AS (SELECT DISTINCT namespace(m.term) AS vendor, m.obj FROM {matches} m JOIN {below_ref_DataObject} o ON o.obj = m.obj)
SELECT a.vendor AS one, b.vendor AS other, count(*) AS objects
FROM mapped a JOIN mapped b ON a.obj = b.obj AND a.vendor < b.vendor
GROUP BY a.vendor, b.vendor
ORDER BY one, other
