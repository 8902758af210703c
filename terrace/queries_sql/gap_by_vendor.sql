-- What does a vendor not map?
WITH other AS (
  SELECT obj, concat(short_name(term), ':', local_name(term), ' (', local_name(match), ')') AS shown FROM {matches} WHERE NOT startswith(term, :VENDOR)
)
SELECT o.obj, l.o AS label, min(c.o) AS note, array_join(array_sort(collect_list(x.shown)), ' | ') AS other_vendors
FROM {below_ref_DataObject} o
JOIN {triples} l ON l.s = o.obj AND l.p = :rdfs_label
LEFT JOIN {triples} c ON c.s = o.obj AND c.p = :rdfs_comment
LEFT JOIN other x ON x.obj = o.obj
WHERE NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.obj = o.obj AND startswith(m.term, :VENDOR))
GROUP BY o.obj, l.o
ORDER BY label
