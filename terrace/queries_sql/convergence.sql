-- What do all vendors map closely?
SELECT o.obj, l.o AS label, count(DISTINCT namespace(m.term)) AS vendors, array_join(array_sort(collect_list(concat(short_name(m.term), ':', local_name(m.term)))), ' | ') AS terms
FROM {below_ref_DataObject} o
JOIN {triples} l ON l.s = o.obj AND l.p = :rdfs_label
JOIN {matches} m ON m.obj = o.obj AND m.match = :skos_closeMatch
GROUP BY o.obj, l.o
HAVING vendors = (SELECT count(*) FROM {vendors})
ORDER BY label
