-- Which judged terms of a vendor have no source document?
SELECT v.term, l.o AS label, v.verdict
FROM {verdicts} v
LEFT JOIN {triples} l ON l.s = v.term AND l.p = :rdfs_label
WHERE startswith(v.term, :VENDOR) AND NOT EXISTS (SELECT 1 FROM {triples} d WHERE d.s = v.term AND endswith(d.p, '#sourceDoc'))
ORDER BY term
