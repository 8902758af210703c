-- What does one vendor map that another doesn't?
SELECT o.obj, l.o AS label, m.term, m.match
FROM {below_ref_DataObject} o
JOIN {triples} l ON l.s = o.obj AND l.p = :rdfs_label
JOIN {matches} m ON m.obj = o.obj AND startswith(m.term, :FROM)
WHERE NOT EXISTS (SELECT 1 FROM {matches} x WHERE x.obj = o.obj AND startswith(x.term, :TO))
ORDER BY label, term
