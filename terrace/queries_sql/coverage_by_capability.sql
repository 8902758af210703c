-- What do capabilities operate on, and who maps that?
SELECT c.obj AS capability, n.o AS capability_label, u.o AS obj, l.o AS label, m.term, m.match, v.verdict
FROM {below_ref_Capability} c
JOIN {triples} n ON n.s = c.obj AND n.p = :rdfs_label
JOIN {triples} u ON u.s = c.obj AND u.p = :ref_operatesOn
JOIN {triples} l ON l.s = u.o AND l.p = :rdfs_label
LEFT JOIN {matches} m ON m.obj = u.o
LEFT JOIN {verdicts} v ON v.term = m.term
ORDER BY capability_label, label, term
