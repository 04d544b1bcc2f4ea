"""The driver's tables seen as memories, queries, users, events; the same projection in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

START = "TIMESTAMP_NTZ '2024-01-01 00:00:00'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of 1 to 4000 characters as memories."""
    docs = table(spark, sf_dir, "documents").filter(F.length(F.trim("text")).between(1, 4000))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    n, at = F.length("text"), F.expr(f"{START} + INTERVAL '30' MINUTE * doc_id")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(
        F.col("doc_id").alias("memory_id"),
        F.when(F.col("lang") == "en", 1).when(F.col("lang") == "fr", 2).when(F.col("lang") == "de", 3).otherwise(4).cast("long").alias("user_id"),
        F.col("text").alias("content"),
        F.when(n < 500, "preference.coding").when(n < 1000, "decision").when(n < 2000, "fact.project").otherwise("experience").alias("category"),
        F.when(n.between(1000, 1999), F.col("lang")).alias("subcategory"),
        F.array("lang", "source").alias("tags"),
        F.when(F.col("quality").isNull(), 1.0).when(F.col("quality") == 1, 0.9).otherwise(0.6).alias("confidence"),
        at.alias("created_at"),
        at.alias("updated_at"),
        F.when(F.col("doc_id") % 11 == 0, at + F.expr("INTERVAL '5' DAY")).alias("expires_at"),
        F.when((F.col("doc_id") % 13 == 0) & (F.col("doc_id") > 0), F.col("doc_id") - 1).alias("superseded_by"),
        F.when(F.col("doc_id") % 17 == 0, at + F.expr("INTERVAL '1' DAY")).alias("deleted_at"),
    )


def clock(spark: SparkSession, sf_dir: str) -> Column:
    """Four days after the newest document, as a literal; the id column's statistics are all that is read."""
    top = table(spark, sf_dir, "documents").agg(F.max("doc_id")).first()[0] or 0
    return F.expr(f"{START} + INTERVAL '30' MINUTE * {top} + INTERVAL '4' DAY")


def accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View events as accesses: (memory_id, at)."""
    n = table(spark, sf_dir, "documents").count()
    return table(spark, sf_dir, "events").filter("event_type = 'view'").select((F.col("event_id") % max(n, 1)).alias("memory_id"), F.col("ts").alias("at"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories with access counts and importance."""
    from ..functions.scores import importance
    from ..operators.recall import access_rollup

    rows = memories(spark, sf_dir).join(access_rollup(accesses(spark, sf_dir)), "memory_id", "left")
    value = importance(F.col("created_at"), F.col("last_accessed_at"), F.col("access_count"), clock(spark, sf_dir))
    return rows.withColumn("access_count", F.coalesce("access_count", F.lit(0))).withColumn("importance", value)


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as recall queries of four users."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 4 + 1).alias("user_id"), "text", F.lit(8).cast("long").alias("k"))


#: The same in SQL; each is a common table expression.
SQL = {
    "now": "now AS (SELECT TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 30 MINUTE * max(doc_id) + INTERVAL 4 DAY AS now FROM documents)",
    "mem": """mem AS (
  SELECT d.doc_id AS memory_id,
    CAST(CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 ELSE 4 END AS BIGINT) AS user_id, text AS content,
    CASE WHEN length(text) < 500 THEN 'preference.coding' WHEN length(text) < 1000 THEN 'decision' WHEN length(text) < 2000 THEN 'fact.project' ELSE 'experience' END AS category,
    CASE WHEN length(text) BETWEEN 1000 AND 1999 THEN lang END AS subcategory, [lang, source] AS tags,
    CAST(CASE WHEN quality IS NULL THEN 1.0 WHEN quality = 1 THEN 0.9 ELSE 0.6 END AS DOUBLE) AS confidence,
    TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 30 MINUTE * d.doc_id AS created_at, created_at AS updated_at,
    CASE WHEN d.doc_id % 11 = 0 THEN created_at + INTERVAL 5 DAY END AS expires_at,
    CASE WHEN d.doc_id % 13 = 0 AND d.doc_id > 0 THEN d.doc_id - 1 END AS superseded_by,
    CASE WHEN d.doc_id % 17 = 0 THEN created_at + INTERVAL 1 DAY END AS deleted_at
  FROM documents d LEFT JOIN (SELECT doc_id, quality FROM labels) l ON d.doc_id = l.doc_id WHERE length(trim(text)) BETWEEN 1 AND 4000)""",
    "roll": "roll AS (SELECT event_id % (SELECT count(*) FROM documents) AS memory_id, count(*) AS access_count, max(ts) AS last_accessed_at FROM events WHERE event_type = 'view' GROUP BY 1)",
    "imp": """imp AS (
  SELECT m.*, coalesce(r.access_count, 0) AS access_count, r.last_accessed_at,
    0.35 + 0.65 * greatest(0, least(1, 0.5 * pow(0.5, greatest(0, floor(epoch(now.now) - epoch(coalesce(r.last_accessed_at, m.created_at)))) / 86400.0 / 90) + 0.5 * (1 - pow(0.5, coalesce(r.access_count, 0) / 5.0)))) AS importance
  FROM mem m CROSS JOIN now LEFT JOIN roll r ON m.memory_id = r.memory_id)""",
    "live": "live AS (SELECT m.* FROM imp m CROSS JOIN now WHERE deleted_at IS NULL AND superseded_by IS NULL AND (expires_at IS NULL OR expires_at > now.now))",
    "asked": "asked AS (SELECT item_id AS query_id, item_id % 4 + 1 AS user_id, text FROM benchmark)",
    "vec": """words AS (SELECT memory_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) AS w FROM mem),
slots AS (SELECT memory_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64 AS d, 1.0::DOUBLE AS x FROM words UNION ALL SELECT memory_id, CAST(('0x' || substring(md5(w), 9, 8)) AS BIGINT) % 64, 0.5 FROM words),
sums AS (SELECT memory_id, d, sum(x) AS x FROM slots GROUP BY ALL),
raw AS (SELECT memory_id, map_from_entries(list({k: d, v: x})) AS m, sqrt(sum(x * x)) AS size FROM sums GROUP BY memory_id),
vec AS (SELECT m.user_id, m.memory_id, CASE WHEN size > 0 THEN list_transform(range(64), lambda i: coalesce(r.m[i], 0.0) / size) ELSE list_transform(range(64), lambda i: 0.0::DOUBLE) END AS embedding FROM mem m LEFT JOIN raw r USING (memory_id))""",
    "qvec": """qwords AS (SELECT query_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS w FROM asked),
qslots AS (SELECT query_id, CAST(('0x' || substring(md5(w), 1, 8)) AS BIGINT) % 64 AS d, 1.0::DOUBLE AS x FROM qwords UNION ALL SELECT query_id, CAST(('0x' || substring(md5(w), 9, 8)) AS BIGINT) % 64, 0.5 FROM qwords),
qsums AS (SELECT query_id, d, sum(x) AS x FROM qslots GROUP BY ALL),
qraw AS (SELECT query_id, map_from_entries(list({k: d, v: x})) AS m, sqrt(sum(x * x)) AS size FROM qsums GROUP BY query_id),
qvec AS (SELECT query_id, list_transform(range(64), lambda i: coalesce(m[i], 0.0) / size) AS embedding FROM qraw)""",
    "near": """near AS (
  SELECT * FROM (SELECT a.query_id, a.user_id, v.memory_id, row_number() OVER (PARTITION BY a.query_id ORDER BY round(sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 12), v.memory_id) AS vector_rank
    FROM asked a JOIN qvec q ON a.query_id = q.query_id JOIN vec v ON a.user_id = v.user_id JOIN mem m ON m.memory_id = v.memory_id WHERE m.deleted_at IS NULL) WHERE vector_rank <= 32)""",
    "post": """stored AS (SELECT * FROM mem WHERE deleted_at IS NULL),
fields AS (SELECT user_id, memory_id, 'content' AS field, content AS t FROM stored UNION ALL SELECT user_id, memory_id, 'tags', array_to_string(tags, ' ') FROM stored UNION ALL SELECT user_id, memory_id, 'category', category FROM stored),
tok AS (SELECT user_id, memory_id, field, list_filter(regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+'), lambda w: strlen(w) < 40) AS ws FROM fields),
stat AS (SELECT user_id, field, count(*) AS n, avg(len(ws)) AS avgdl FROM tok GROUP BY ALL),
post AS (SELECT user_id, memory_id, field, term, dl, count(*) AS tf FROM (SELECT user_id, memory_id, field, len(ws) AS dl, unnest(ws) AS term FROM tok) GROUP BY ALL),
seen AS (SELECT user_id, field, term, count(*) AS df FROM post GROUP BY ALL)""",
    "key": """qterm AS (SELECT DISTINCT query_id, user_id, unnest(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda w: strlen(w) < 40)) AS term FROM asked),
tw AS (SELECT p.user_id, p.memory_id, p.term, sum(round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9)) AS weight
  FROM post p JOIN seen s ON p.user_id = s.user_id AND p.field = s.field AND p.term = s.term JOIN stat t ON p.user_id = t.user_id AND p.field = t.field
  WHERE p.term IN (SELECT term FROM qterm) GROUP BY ALL),
hits AS (SELECT q.query_id, q.user_id, memory_id, round(sum(weight), 6) AS bm25 FROM qterm q JOIN tw ON q.user_id = tw.user_id AND q.term = tw.term GROUP BY ALL),
kw AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, memory_id) AS keyword_rank FROM hits WHERE bm25 > 0) WHERE keyword_rank <= 32)""",
    "fused": """fused AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.user_id, k.user_id) AS user_id, coalesce(v.memory_id, k.memory_id) AS memory_id, vector_rank, keyword_rank,
    coalesce(1.0 / (60 + vector_rank), 0) + coalesce(1.0 / (60 + keyword_rank), 0) AS rrf FROM near v FULL JOIN kw k ON v.query_id = k.query_id AND v.memory_id = k.memory_id)""",
    "ans": """ans AS (SELECT f.*, m.* EXCLUDE (memory_id, user_id), round(rrf * (0.8 + 0.2 * greatest(0, least(1, pow(0.5, greatest(0, floor(epoch(now.now) - epoch(created_at))) / 86400.0 / 90)))) * (0.8 + 0.2 * greatest(0, least(1, confidence * importance))), 12) AS score
  FROM fused f JOIN imp m ON f.memory_id = m.memory_id CROSS JOIN now)""",
}


def sql(select: str, *names: str) -> str:
    """A query over the named common table expressions and those that they need."""
    needs = {"imp": ("now", "mem", "roll"), "live": ("imp",), "vec": ("mem",), "qvec": ("asked",), "near": ("qvec", "vec"), "post": ("mem",), "key": ("asked", "post"), "fused": ("near", "key"), "ans": ("imp", "fused")}
    order: list[str] = []

    def add(name: str) -> None:
        for n in needs.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    return f"WITH {', '.join(SQL[n] for n in order)} {select}"
