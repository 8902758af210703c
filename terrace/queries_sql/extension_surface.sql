-- Which terms are a vendor's own? An empty VENDOR means all.
SELECT namespace(d.s) AS vendor, d.s AS term, l.o AS label
FROM {triples} d
JOIN {triples} v ON v.s = d.s AND endswith(v.p, 'verdict') AND v.o = 'vendor-extension'
JOIN {triples} l ON l.s = d.s AND l.p = :rdfs_label
WHERE d.p = :rdfs_subClassOf AND endswith(d.o, '#DataObject') AND startswith(d.s, :VENDOR)
  AND NOT EXISTS (SELECT 1 FROM {matches} m WHERE m.term = d.s AND startswith(m.obj, :ref_))
ORDER BY vendor, label
