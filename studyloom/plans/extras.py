"""Queries over the remaining operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from studyloom.functions import text as T
from studyloom.operators import chunking as C
from studyloom.operators import names as N
from studyloom.operators import performance as P
from studyloom.operators import retrieval as R
from studyloom.operators.bank import LOOKUP
from studyloom.plans.bank import PAIRS, SPACE, sql_normal
from studyloom.plans.performance import GRADED, _graded
from studyloom.plans.registry import query
from studyloom.session import ship, table
from studyloom.sources import tables as S


def _q(spark, d):
    return table(spark, d, "questions")


@query("SELECT c.chunk_id, text FROM (SELECT DISTINCT NULLIF(source_chunk_id, '') AS chunk_id FROM questions) c LEFT JOIN (SELECT chunk_id, ARG_MIN(text, ROW(chunk_index, text)) AS text FROM chunk GROUP BY 1) t USING (chunk_id)")
def chunk_text_lookup(spark, d):
    asked = _q(spark, d).select(F.nullif(F.col("source_chunk_id"), F.lit("")).alias("chunk_id"))
    return R.chunk_text(asked, table(spark, d, "chunk"))


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) class, subject, chapter, topic, source_file, topic_number, chunk_index, chunk_id FROM chunk)
SELECT class, subject, chapter, topic, chunk_id, CAST(ROW_NUMBER() OVER (PARTITION BY class, subject, chapter, topic ORDER BY source_file, COALESCE(topic_number, ''), chunk_index, chunk_id) AS INT) AS place FROM r QUALIFY place <= 5"""
)
def grounding_chunks(spark, d):
    return R.grounding(table(spark, d, "chunk"))


@query("SELECT chunk_id, chapter, topic FROM chunk WHERE class = '9' AND subject = 'Biology' AND has_table")
def metadata_scan(spark, d):
    return S.scan(spark, d, "chunk", **{"class": "9", "subject": "Biology", "chapter": None, "has_table": True}).select("chunk_id", "chapter", "topic")


@query(
    """SELECT question_id, source_chunk_id IN (SELECT chunk_id FROM source_repairs WHERE chunk_id IS NOT NULL) AND (payload->>'$.source_revision') IS DISTINCT FROM '2' AS needs_review FROM questions"""
)
def needs_review(spark, d):
    return R.quarantine(_q(spark, d), table(spark, d, "source_repairs"), "2")


@query(
    """SELECT question_id FROM questions WHERE source_chunk_id NOT IN (SELECT chunk_id FROM source_repairs WHERE chunk_id IS NOT NULL) OR COALESCE((payload->>'$.source_revision') = '2', FALSE)"""
)
def quarantine_filter(spark, d):
    return R.quarantine(_q(spark, d), table(spark, d, "source_repairs"), "2").where("NOT needs_review").select("question_id")


@query(
    f"""WITH {PAIRS}, j AS (SELECT i.*, q.batch_no, LOWER(q.text_hash) = identity AS hash_is_current, FIRST_VALUE(i.question_id) OVER (PARTITION BY i.class, i.subject, i.chapter, i.topic, identity ORDER BY q.batch_no, i.created_at, i.question_id) AS first
FROM i JOIN questions q USING (question_id))
SELECT question_id, CASE WHEN first = question_id THEN 'accepted' ELSE 'exact_duplicate' END AS reason, NULLIF(first, question_id) AS duplicate_of, hash_is_current FROM j"""
)
def intake_disposition(spark, d):
    return R.intake(_q(spark, d))


@query(
    """WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, r.vec_id AS row_id, ROUND(LIST_COSINE_SIMILARITY(q.v, r.v), 6) AS similarity FROM e q JOIN e r USING (label) WHERE q.vec_id % 50 = 0 AND q.vec_id <> r.vec_id)
SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS INT) AS rank FROM p QUALIFY rank <= 5"""
)
def knn_topk_filtered(spark, d):
    """Queries are the rows whose id 50 divides, against all rows of their label."""
    e = table(spark, d, "embeddings")
    return R.nearest(e.where("vec_id % 50 = 0"), e, "label", "vec_id", "embedding", 5)


def _line(n: int, kind: str) -> str:
    taken = " ".join(f"AND cluster NOT IN (SELECT cluster FROM l{k} WHERE l{k}.request_id = q.request_id)" for k in range(1, n))
    return f"""l{n} AS (SELECT request_id, {n} AS line_no, question_id, cluster FROM (SELECT * FROM q WHERE type = '{kind}' QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id, cluster ORDER BY place) = 1) q
WHERE TRUE {taken} QUALIFY ROW_NUMBER() OVER (PARTITION BY request_id ORDER BY place) <= 5)"""


@query(
    """WITH r AS (SELECT DISTINCT class, subject, difficulty FROM quiz_attempts),
q AS (SELECT class || '/' || subject || '/' || difficulty AS request_id, type, question_id, COALESCE(concept_cluster_id, question_id) AS cluster, SHA256('5|' || question_id) AS place FROM questions JOIN r USING (class, subject, difficulty)),
"""
    + ",\n".join(_line(n, kind) for n, kind in enumerate(("MCQ", "fill_in_blank", "matching"), 1))
    + " SELECT * FROM l1 UNION ALL SELECT * FROM l2 UNION ALL SELECT * FROM l3"
)
def bank_cross_line(spark, d):
    """For each scope of an attempt a request with a line per type; no concept is taken twice."""
    ship(spark)
    requests = table(spark, d, "quiz_attempts").select("class", "subject", "difficulty").distinct()
    q = _q(spark, d).withColumn("question_type", F.col("type")).select(
        *LOOKUP, "question_id", F.coalesce("concept_cluster_id", "question_id").alias("cluster"), T.order_key("5", F.col("question_id")).alias("place")
    )
    lines = F.array_position(F.array(F.lit("MCQ"), F.lit("fill_in_blank"), F.lit("matching")), F.col("question_type")).cast("int")
    rows = requests.join(q, ["class", "subject", "difficulty"]).select(
        F.concat_ws("/", "class", "subject", "difficulty").alias("request_id"), lines.alias("line_no"), F.lit(5).alias("count"), "question_id", "cluster", "place"
    )
    return R.greedy_lines(rows)


@query()
def hashed_embeddings(spark, d):
    ship(spark)
    return table(spark, d, "chunk").select("chunk_id", F.array_join(F.transform(R.hashed_embedding("text"), lambda x: F.round(x, 4).cast("string")), ",").alias("v"))


@query(
    """WITH a AS (SELECT DISTINCT attempt_id, question_id, is_correct FROM attempt_answers) SELECT attempt_id, question_id, type, is_correct, COALESCE(TRIM(explanation), '') <> '' AS explained FROM a JOIN questions USING (question_id)"""
)
def attempt_review(spark, d):
    return R.review(table(spark, d, "attempt_answers"), _q(spark, d))


@query(
    f"""WITH a AS (SELECT DISTINCT attempt_id, question_id, user_answer FROM attempt_answers)
SELECT attempt_id, question_id, type, CASE WHEN user_answer IS NULL THEN FALSE WHEN type = 'matching' THEN LEN(JSON_KEYS(user_answer)) > 0
WHEN type = 'fill_in_blank' THEN {sql_normal("('{\"a\":' || user_answer || '}')->>'$.a'")} <> '' ELSE TRUE END AS answered FROM a JOIN questions USING (question_id)"""
)
def answered_rows(spark, d):
    return R.answered(table(spark, d, "attempt_answers"), _q(spark, d))


@query(
    """WITH c AS (SELECT chunk_id, MIN(SHA256(text)) AS digest, MIN(class) AS chunk_class FROM chunk GROUP BY 1)
SELECT question_id, CASE WHEN difficulty NOT IN ('easy', 'medium', 'hard') THEN 'difficulty' WHEN digest IS NULL THEN 'source unknown' WHEN chunk_class <> class THEN 'source out of scope'
WHEN (payload->>'$.question') IS NULL THEN 'payload' ELSE '' END AS reason FROM questions LEFT JOIN c ON source_chunk_id = chunk_id"""
)
def draft_gate(spark, d):
    return R.gate(_q(spark, d), table(spark, d, "chunk"))


@query("SELECT class, chapter, question_id, CAST(ROW_NUMBER() OVER (PARTITION BY class, chapter ORDER BY SHA256('s|' || question_id)) AS INT) AS place FROM questions QUALIFY place <= 3")
def uniform_sample(spark, d):
    return R.pick_order(_q(spark, d).select("class", "chapter", "question_id"), ["class", "chapter"], "question_id", "s", 3)


@query("SELECT id, NULLIF(answer, '') AS answer, COALESCE(source, 'ncert_intext') AS source FROM reference_corpus")
def corpus_refresh(spark, d):
    return S.refreshed(table(spark, d, "reference_corpus")).select("id", "answer", "source")


@query("SELECT id, class || '|' || subject || '|' || chapter || '|' || CAST(ROW_NUMBER() OVER (PARTITION BY class, subject, chapter ORDER BY id) - 1 AS VARCHAR) AS store_id FROM (SELECT DISTINCT id, class, subject, chapter FROM reference_corpus)")
def corpus_ids(spark, d):
    c = table(spark, d, "reference_corpus").select("id", "class", "subject", "chapter").distinct()
    n = F.row_number().over(Window.partitionBy("class", "subject", "chapter").orderBy("id")) - 1
    return c.select("id", F.concat_ws("|", "class", "subject", "chapter", n.cast("string")).alias("store_id"))


@query("SELECT user_id, ARG_MAX(event_type, ROW(ts, event_id)) AS default_class, MIN(ts) AS created_at, MAX(ts) AS updated_at FROM events GROUP BY 1")
def profile_upsert(spark, d):
    """Events stand in for profile updates: the last value stays, the first time is kept."""
    return table(spark, d, "events").groupBy("user_id").agg(
        F.max_by("event_type", F.struct("ts", "event_id")).alias("default_class"), F.min("ts").alias("created_at"), F.max("ts").alias("updated_at")
    )


@query(
    """WITH t AS (SELECT class, subject, chapter, topic, SUM(LENGTH(TRIM(text, ' '))) AS chars FROM (SELECT DISTINCT ON (chunk_id) * FROM chunk) GROUP BY ALL)
SELECT class, subject, chapter, topic, CAST(ROW_NUMBER() OVER (PARTITION BY class, subject, chapter ORDER BY topic) AS INT) AS place FROM t WHERE chars >= 1500"""
)
def long_topics(spark, d):
    """Topics with enough text, numbered anew."""
    rows = table(spark, d, "chunk").dropDuplicates(["chunk_id"]).groupBy("class", "subject", "chapter", "topic").agg(F.sum(F.length(F.trim("text"))).alias("chars"))
    by = Window.partitionBy("class", "subject", "chapter").orderBy("topic")
    return rows.where("chars >= 1500").select("class", "subject", "chapter", "topic", F.row_number().over(by).alias("place"))


@query(
    f"""WITH l AS (SELECT question_id, text, LAG(text) OVER (PARTITION BY class, subject, chapter, topic ORDER BY created_at, question_id) AS before FROM questions),
w AS (SELECT question_id, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({sql_normal("text")}, ' '), lambda x: x <> '')) AS a, LIST_DISTINCT(LIST_FILTER(STRING_SPLIT({sql_normal("before")}, ' '), lambda x: x <> '')) AS b FROM l WHERE before IS NOT NULL)
SELECT question_id, ROUND(CASE WHEN LEN(a) = 0 OR LEN(b) = 0 THEN 0.0 ELSE LEN(LIST_INTERSECT(a, b)) / (LEN(a) + LEN(b) - LEN(LIST_INTERSECT(a, b)))::DOUBLE END, 6) AS overlap FROM w"""
)
def word_jaccard(spark, d):
    """Each question with the one before it in its topic."""
    by = Window.partitionBy("class", "subject", "chapter", "topic").orderBy("created_at", "question_id")
    q = _q(spark, d).select("question_id", "text", F.lag("text").over(by).alias("before")).where("before IS NOT NULL")
    return q.select("question_id", F.round(T.jaccard(T.word_set("text"), T.word_set("before")), 6).alias("overlap"))


@query(
    GRADED
    + """, u AS (SELECT DISTINCT attempt_id, user_id, class, subject, UNNEST(CAST(scope->'$.sub_units' AS VARCHAR[])) AS unit FROM quiz_attempts),
h AS (SELECT user_id, class, subject, UNNEST([chapter, topic]) AS unit, question_type, correct_count, total_count FROM c)
SELECT attempt_id, unit, question_type, CAST(SUM(correct_count) AS BIGINT) AS correct, CAST(SUM(total_count) AS BIGINT) AS total FROM u JOIN h USING (user_id, class, subject, unit) GROUP BY ALL"""
)
def unit_history(spark, d):
    """What a user has answered in the units that an attempt names."""
    from studyloom.operators.catalog import requested_units

    attempts = table(spark, d, "quiz_attempts")
    users = attempts.select("attempt_id", "user_id").distinct()
    h = P.counters(_graded(spark, d)).select("user_id", "class", "subject", F.explode(F.array("chapter", "topic")).alias("unit"), "question_type", "correct_count", "total_count")
    asked = requested_units(attempts).join(users, "attempt_id").distinct()
    return asked.join(h, ["user_id", "class", "subject", "unit"]).groupBy("attempt_id", "unit", "question_type").agg(
        F.sum("correct_count").alias("correct"), F.sum("total_count").alias("total")
    )


@query(
    """WITH g AS (SELECT UNNEST(['easy', 'medium', 'hard']) AS difficulty), t AS (SELECT UNNEST(['MCQ', 'fill_in_blank', 'matching']) AS question_type), i AS (SELECT UNNEST([0, 1]) AS i),
r AS (SELECT class, subject, chapter, topic, chunk_id, ROW_NUMBER() OVER (PARTITION BY class, subject, chapter, topic ORDER BY chunk_id) - 1 AS p, COUNT(*) OVER (PARTITION BY class, subject, chapter, topic) AS n FROM (SELECT DISTINCT class, subject, chapter, topic, chunk_id FROM chunk))
SELECT class, subject, chapter, topic, difficulty, question_type, CAST(i AS INT) AS i, chunk_id FROM g, t, i JOIN r ON r.p = i % r.n"""
)
def prefill_grid(spark, d):
    """Difficulty x type x two cells for each topic (18 rows each), its chunks taken in turn."""
    by = Window.partitionBy("class", "subject", "chapter", "topic")
    c = table(spark, d, "chunk").select("class", "subject", "chapter", "topic", "chunk_id").distinct()
    c = c.withColumn("p", F.row_number().over(by.orderBy("chunk_id")) - 1).withColumn("n", F.count(F.lit(1)).over(by))
    lists = [F.explode(F.array(*(F.lit(x) for x in xs))) for xs in (("easy", "medium", "hard"), ("MCQ", "fill_in_blank", "matching"), (0, 1))]
    cells = c.where("p < 2").withColumn("difficulty", lists[0]).withColumn("question_type", lists[1]).withColumn("i", lists[2])
    return cells.where("p = i % n").drop("p", "n")


@query("SELECT class, subject, source_file, COUNT(DISTINCT chunk_id) AS chunks, COUNT(*) - COUNT(DISTINCT chunk_id) AS again, CASE WHEN BOOL_OR(chapter = 'Unknown') THEN 'untitled' ELSE 'ok' END AS status FROM chunk GROUP BY ALL")
def ingest_report(spark, d):
    return table(spark, d, "chunk").groupBy("class", "subject", "source_file").agg(
        F.countDistinct("chunk_id").alias("chunks"), (F.count(F.lit(1)) - F.countDistinct("chunk_id")).alias("again"),
        F.when(F.coalesce(F.bool_or(F.col("chapter") == "Unknown"), F.lit(False)), "untitled").otherwise("ok").alias("status"),
    )


@query("SELECT source_file, ARRAY_TO_STRING(LIST_SORT(LIST(DISTINCT topic)), '|') AS topics, COUNT(DISTINCT chunk_id) AS chunks FROM chunk WHERE topic IS NOT NULL GROUP BY 1")
def book_outline(spark, d):
    return table(spark, d, "chunk").where("topic IS NOT NULL").groupBy("source_file").agg(
        F.array_join(F.array_sort(F.collect_set("topic")), "|").alias("topics"), F.countDistinct("chunk_id").alias("chunks")
    )


@query("SELECT attempt_id, CASE WHEN scope->>'$.scope_type' = 'subject' THEN 'all_chapters_in_subject' WHEN scope->>'$.scope_type' = 'chapter' THEN 'all_topics_in_chapter' WHEN LEN(CAST(scope->'$.sub_units' AS VARCHAR[])) <= 1 THEN 'single_topic' ELSE 'multi_topic' END AS scope FROM (SELECT DISTINCT attempt_id, scope FROM quiz_attempts)")
def scope_types(spark, d):
    a = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"])
    kind, units = F.get_json_object("scope", "$.scope_type"), F.size(F.from_json(F.get_json_object("scope", "$.sub_units"), "array<string>"))
    return a.select(
        "attempt_id", F.when(kind == "subject", "all_chapters_in_subject").when(kind == "chapter", "all_topics_in_chapter").when(units <= 1, "single_topic").otherwise("multi_topic").alias("scope")
    )


@query(
    """WITH t AS (SELECT DISTINCT * FROM quiz_attempts), b AS (SELECT attempt_id, COUNT(DISTINCT question_id) AS questions, COUNT(DISTINCT question_id) FILTER (user_answer IS NOT NULL) AS answered, COUNT(DISTINCT topic) AS topics
FROM (SELECT DISTINCT attempt_id, question_id, user_answer FROM attempt_answers) JOIN questions USING (question_id) GROUP BY 1)
SELECT t.attempt_id, CASE WHEN score_total > 0 THEN CAST(ROUND(100.0 * score_correct / score_total) AS INT) ELSE 0 END AS percent, COALESCE(answered, 0) AS answered, COALESCE(topics, 0) AS topics,
LEAST(100.0::DOUBLE, 10.0::DOUBLE * COUNT(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)) AS bar FROM t LEFT JOIN b USING (attempt_id)"""
)
def result_percent(spark, d):
    """Of each attempt: the score in per cent, questions answered, distinct topics, and the share of ten attempts a day that were used by then."""
    a = table(spark, d, "quiz_attempts").dropDuplicates(["attempt_id"])
    answers = table(spark, d, "attempt_answers").join(_q(spark, d).select("question_id", "topic"), "question_id")
    of = answers.groupBy("attempt_id").agg(F.countDistinct(F.when(F.col("user_answer").isNotNull(), F.col("question_id"))).alias("answered"), F.countDistinct("topic").alias("topics"))
    used = P.rolling_use(table(spark, d, "quiz_attempts")).select("attempt_id", F.least(F.lit(100.0), 10.0 * F.col("used")).alias("bar"))
    percent = F.when(F.col("score_total") > 0, F.round(F.lit(100.0) * F.col("score_correct") / F.col("score_total")).cast("int")).otherwise(0)
    return a.select("attempt_id", percent.alias("percent")).join(of, "attempt_id", "left").join(used, "attempt_id").fillna(0, ["answered", "topics"])


@query(
    f"""WITH p AS (SELECT question_id, SUM((x.key IS NOT NULL)::INT) AS n FROM questions, JSON_EACH(payload, '$.pairs') x WHERE questions.type = 'matching' GROUP BY 1)
SELECT question_id, CAST(n AS INT) AS pairs, TRIM(REGEXP_REPLACE(text, '{SPACE}', ' ', 'g')) AS title FROM p JOIN questions USING (question_id)"""
)
def matching_sizes(spark, d):
    q = _q(spark, d).where("type = 'matching'")
    pairs = F.size(F.map_keys(F.from_json(F.get_json_object("payload", "$.pairs"), "map<string, string>")))
    return q.select("question_id", pairs.alias("pairs"), F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("title"))


TOPIC = ["class", "subject", "source_file", "chapter", "topic_number", "topic"]


@query()
def topic_pieces(spark, d):
    """The texts of the book's topics, the long ones cut."""
    t = table(spark, d, "chunk").dropDuplicates(["chunk_id"]).groupBy(*TOPIC).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return C.topic_pieces(t, TOPIC)


@query(
    """WITH r AS (SELECT DISTINCT ON (chunk_id) * FROM chunk), t AS (SELECT class, subject, source_file, chapter, topic_number, topic, STRING_AGG(text, chr(10) ORDER BY chunk_index, chunk_id, text) AS text FROM r GROUP BY ALL),
m AS (SELECT CASE WHEN LENGTH(COALESCE(text, '')) <= 3000 OR COALESCE(topic_number, '') = '' THEN 'none' WHEN LEN(LIST_FILTER(STRING_SPLIT(text, chr(10)), lambda x: REGEXP_FULL_MATCH(x, '\\d+\\.\\d+\\.\\d+\\s+.{2,100}'))) > 0 THEN 'sub-subheading' ELSE 'paragraph-group' END AS method FROM t)
SELECT method, COUNT(*) AS topics FROM m GROUP BY 1"""
)
def topic_split_methods(spark, d):
    first = topic_pieces(spark, d).where("chunk_index = 0")
    return first.groupBy(F.col("split_method").alias("method")).agg(F.count(F.lit(1)).alias("topics"))


@query()
def clean_names(spark, d):
    c = table(spark, d, "chunk").select(N.clean_name(F.col("chapter")).alias("chapter"))
    return c.groupBy("chapter").agg(F.count(F.lit(1)).alias("n"), F.min(F.length("chapter")).alias("size"))


@query(
    """WITH a AS (SELECT label, vec_id, CAST(embedding AS DOUBLE[]) AS v, LAG(CAST(embedding AS DOUBLE[])) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
s AS (SELECT ROUND(LIST_COSINE_SIMILARITY(v, w), 6) AS s, label < 5 AS near FROM a WHERE w IS NOT NULL), m AS (SELECT MIN(CASE WHEN near THEN s END) AS low, MAX(CASE WHEN NOT near THEN s END) AS high FROM s)
SELECT low, high, low > high AS apart, CASE WHEN low > high THEN ROUND((low + high) / 2, 6) END AS middle FROM m"""
)
def gap_report(spark, d):
    """Whether two labelled groups of similarities are apart, and the middle between them."""
    from studyloom.operators.dedup import cosine

    by = Window.partitionBy("label").orderBy("vec_id")
    e = table(spark, d, "embeddings").select("label", "embedding", F.lag("embedding").over(by).alias("w")).where("w IS NOT NULL")
    s = e.select(F.round(cosine(F.col("embedding"), F.col("w")), 6).alias("s"), (F.col("label") < 5).alias("near"))
    m = s.agg(F.min(F.when(F.col("near"), F.col("s"))).alias("low"), F.max(F.when(~F.col("near"), F.col("s"))).alias("high"))
    return m.select("low", "high", (F.col("low") > F.col("high")).alias("apart"), F.when(F.col("low") > F.col("high"), F.round((F.col("low") + F.col("high")) / 2, 6)).alias("middle"))
