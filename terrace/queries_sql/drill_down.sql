-- All mappings of one concept.
SELECT namespace(m.term) AS vendor, m.term, m.match, l.o AS label, v.verdict, d.o AS source_doc
FROM {matches} m
LEFT JOIN {triples} l ON l.s = m.term AND l.p = :rdfs_label
LEFT JOIN {verdicts} v ON v.term = m.term
LEFT JOIN {triples} d ON d.s = m.term AND endswith(d.p, '#sourceDoc')
WHERE m.obj = :REF_CONCEPT
ORDER BY vendor, term
