-- Which vendor terms map to each reference object?
SELECT o.obj, l.o AS label, namespace(m.term) AS vendor, m.term, m.match, v.verdict
FROM {below_ref_DataObject} o
JOIN {triples} l ON l.s = o.obj AND l.p = :rdfs_label
LEFT JOIN {matches} m ON m.obj = o.obj
LEFT JOIN {verdicts} v ON v.term = m.term
ORDER BY label, vendor
