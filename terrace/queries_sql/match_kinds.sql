-- How does each vendor map: its edges by kind, and the share of them that is judged covered.
SELECT namespace(m.term) AS vendor, local_name(m.match) AS kind, count(*) AS edges, count_if(v.verdict = 'covered') AS covered
FROM {matches} m
LEFT JOIN {verdicts} v ON v.term = m.term
GROUP BY vendor, kind
ORDER BY vendor, kind
