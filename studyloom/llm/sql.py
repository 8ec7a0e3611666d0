"""DuckDB statements of the pN_ queries that SQL can express: plain brute force over whole tables, for checks on small scales."""

PLAIN = "REGEXP_REPLACE(LOWER({x}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def plain(x: str) -> str:
    return PLAIN.format(x=x)


def listed(path: str) -> str:
    return f"ARRAY_TO_STRING(LIST_TRANSFORM(CAST(payload->'{path}' AS VARCHAR[]), lambda v: {plain('v')}), ',')"


USABLE = """u AS (SELECT question_id, batch_no, CAST(embedding AS DOUBLE[384]) AS v FROM questions
WHERE LEN(embedding) = 384 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0)"""

NEAR = f"""{USABLE},
s AS (SELECT a.question_id AS id, b.question_id AS neighbour, ROUND(ARRAY_COSINE_SIMILARITY(a.v, b.v), 9) AS similarity FROM u a JOIN u b ON a.question_id <> b.question_id),
t AS (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY id ORDER BY similarity DESC, neighbour) AS INT) AS rank FROM s QUALIFY rank <= 10),
n AS (SELECT * FROM t WHERE similarity >= 0.8)"""

WORDS = r"""s AS (SELECT question_id, text AS x FROM questions
UNION ALL SELECT question_id, e.value->>'$' FROM questions, JSON_TREE(payload) e WHERE e.type = 'VARCHAR'
UNION ALL SELECT question_id, e.key FROM questions, JSON_EACH(payload, '$.pairs') e WHERE questions.type = 'matching'),
w AS (SELECT DISTINCT question_id, UNNEST(REGEXP_EXTRACT_ALL(LOWER(x), '[\p{L}\p{N}]+')) AS word FROM s),
c AS (SELECT question_id, COUNT(*) AS n FROM w GROUP BY 1),
b AS (SELECT a.question_id AS i, b.question_id AS j, COUNT(*) AS shared FROM w a JOIN w b ON a.word = b.word AND a.question_id < b.question_id GROUP BY 1, 2)"""

RECORDS = f"""k AS (SELECT question_id, type || '|' || {plain('text')} || '|' || {plain("payload->>'$.question'")} || '|' || CASE type
WHEN 'MCQ' THEN {listed('$.options')} || '#' || CAST(CAST(payload->>'$.correct_option_index' AS DOUBLE) AS VARCHAR)
WHEN 'fill_in_blank' THEN {plain("payload->>'$.answer'")} || '|' || {listed('$.accepted_answers')}
ELSE {listed('$.left_items')} || '|' || {listed('$.right_items')} || '|' || (SELECT STRING_AGG(p, ',' ORDER BY p) FROM (SELECT {plain('e.key')} || ':' || {plain("e.value->>'$'")} AS p FROM JSON_EACH(payload, '$.pairs') e)) END AS key
FROM questions),
r AS (SELECT question_id, MIN(question_id) OVER (PARTITION BY key) AS kept_id FROM (SELECT DISTINCT * FROM k))"""

SQL = {
    "p1_found": f"WITH {NEAR} SELECT DISTINCT LEAST(id, neighbour) AS question_id_a, GREATEST(id, neighbour) AS question_id_b FROM n",
    "p1_similar": f"WITH {NEAR} SELECT * FROM t",
    "p2_found": f"WITH {WORDS} SELECT i AS question_id_a, j AS question_id_b FROM b JOIN c x ON x.question_id = i JOIN c y ON y.question_id = j WHERE shared / (x.n + y.n - shared) >= 0.6",
    "p3_found": "SELECT DISTINCT chunk_id FROM chunk WHERE LENGTH(text) > 3000",
    "p5_found": f"""WITH {USABLE}, h AS (SELECT LOWER(text_hash) AS h, MIN(batch_no) AS met FROM questions GROUP BY 1)
SELECT question_id FROM questions JOIN h ON LOWER(text_hash) = h WHERE met < batch_no
UNION SELECT a.question_id FROM u a WHERE EXISTS (SELECT 1 FROM u b WHERE b.batch_no < a.batch_no AND ARRAY_COSINE_SIMILARITY(a.v, b.v) >= 0.9)""",
    "p7_found": f"WITH {RECORDS} SELECT kept_id, question_id AS copy_id FROM r WHERE kept_id <> question_id",
    "p7_representatives": f"WITH {RECORDS} SELECT kept_id, COUNT(*) AS copies FROM r GROUP BY 1",
}
