"""The registered query of each training-data operator, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_decode, bpe_encode, n_ids
from .collocations import collocations
from .common import table
from .exact import exact_dedup
from .jaccard import jaccard_join
from .language import fit, identify
from .neighbours import nearest
from .packing import pack
from .private import key_table, pseudonymise
from .secrets import scan
from .token_files import token_files
from .urls import CHROME, LEAST_WORDS, MARKERS, SUFFIXES, Rule, judge, page_outcome
from .variants import variants
from .vector_dedup import vector_dedup

BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode the ids, and digest both."""
    encoded = bpe_encode(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_VOCABULARY)
    decoded = bpe_decode(encoded, "doc_id", "ids_le", BYTE_VOCABULARY, keep_ids=True)
    return decoded.select("doc_id", n_ids(F.col("ids_le")).alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))


def op2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every hundredth vector, against all vectors."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 100 == 0, 10)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of 1024."""
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text", BYTE_VOCABULARY, 1024, 0)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every document's ids to Parquet and index what the files hold."""
    return token_files(table(spark, sf_dir, "documents"), "doc_id", "text", WORD_VOCABULARY)


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of all vectors with cosine of at least 0.9."""
    return vector_dedup(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.9)


#: Example key: a caller's own key is a parameter of ``pseudonymise``.
PSEUDONYM_KEY = "example pseudonym key"
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with personal data pseudonymised: doc_id, text, n_private."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", key_table(spark, PSEUDONYM_KEY))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes and links of all documents: five-word shingles, similarity of at least 0.8."""
    return jaccard_join(table(spark, sf_dir, "documents"), "doc_id", "text", 5, 0.8).select("doc_id", "class_id", "n_links", "kept")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every page's url; outcomes come from the pages' own text and addresses."""
    return judge(table(spark, sf_dir, "pages"), "page_id", "url", RULES, page_outcome(F.col("url"), F.col("html"))).drop("bound")


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that language identification never learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learn from the labelled documents that are not held out; predict every document's language."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()), "doc_id", "text", "lang")
    return identify(docs, "text", model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return scan(table(spark, sf_dir, "documents"), "doc_id", "text")


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    return exact_dedup(table(spark, sf_dir, "documents"), "doc_id", "text")


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of all documents."""
    return variants(table(spark, sf_dir, "documents"), "doc_id", "text")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of two or three words of each language."""
    return collocations(table(spark, sf_dir, "documents"), "text", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_neighbours, op3_packing, op4_vector_dedup, op5_pii, op6_jaccard, op7_urls, op8_token_files, op9_language, op10_secrets, op11_exact_dedup, op12_variants, op13_collocations)}


#: Cosine of all pairs; components by reachability.
OP4_SQL = """WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))) >= 0.9),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x), c AS (SELECT x, min(y) AS c FROM reach GROUP BY x)
SELECT vec_id, coalesce(n.n, 0) AS n_links, least(vec_id, coalesce(c.c, vec_id)) AS component_id, vec_id <= coalesce(c.c, vec_id) AS kept FROM embeddings LEFT JOIN n ON n.x = vec_id LEFT JOIN c ON c.x = vec_id"""

#: Shingle sets by equality join; components by reachability.
OP6_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM i JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE k / (cx.n + cy.n - k) >= 0.8),
reach AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON r.y = l.x),
n AS (SELECT x, count(*) AS n FROM link GROUP BY x), m AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT doc_id, least(doc_id, coalesce(m.m, doc_id)) AS class_id, coalesce(n.n, 0) AS n_links, doc_id <= coalesce(m.m, doc_id) AS kept FROM documents LEFT JOIN n ON n.x = doc_id LEFT JOIN m ON m.x = doc_id"""


def _strength(groups: str) -> str:
    """Prior strength of a level, as in ``urls.strength``."""
    return f"(SELECT CASE WHEN coalesce(x, 0) <= 0 OR coalesce(t, 0) <= 0 THEN 200.0 ELSE least(200.0, greatest(2.0, t / x - 1)) END FROM (SELECT sum(n * ((good / n - above) * (good / n - above) - above * (1 - above) / n)) AS x, sum(n * above * (1 - above)) AS t FROM {groups} WHERE n > 0))"


def _listed(values: tuple[str, ...]) -> str:
    return ", ".join(f"'{x}'" for x in values)


OP7_SQL = rf"""WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest,
  CASE WHEN html IS NOT NULL AND url IS NOT NULL THEN CASE WHEN len(regexp_extract_all(regexp_replace(html, '{CHROME}', ' ', 'g'), '\p{{L}}+')) >= {LEAST_WORDS} AND NOT regexp_matches(lower(url), '{"|".join(MARKERS)}') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END AS outcome FROM pages),
p AS (SELECT page_id, outcome, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path, regexp_replace(host, '^.*@|:[0-9]*$|\.+$', '', 'g') AS name FROM u),
r AS (SELECT *, CASE WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/' WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/' WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/' END AS rule FROM p),
g AS (SELECT name, split_part(name, '.', -1) AS one, CASE WHEN contains(name, '.') THEN split_part(name, '.', -2) || '.' || one ELSE name END AS two, count(outcome)::DOUBLE AS n, coalesce(sum(outcome), 0) AS good FROM r GROUP BY name),
h AS (SELECT name, n, good, CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name WHEN two IN ({_listed(SUFFIXES)}) THEN two ELSE one END AS suffix,
  CASE WHEN regexp_full_match(name, '[0-9.]+') THEN name WHEN two IN ({_listed(SUFFIXES)}) AND name <> two THEN split_part(name, '.', -3) || '.' || two ELSE two END AS domain FROM g),
t AS (SELECT (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS top FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(good) AS good, any_value(top) AS above FROM h, t GROUP BY suffix), k0 AS (SELECT {_strength("s0")} AS s),
s1 AS (SELECT suffix, (good + s * above) / (n + s) AS rate FROM s0, k0),
d0 AS (SELECT domain, h.suffix, sum(n) AS n, sum(good) AS good, any_value(rate) AS above FROM h JOIN s1 ON h.suffix = s1.suffix GROUP BY domain, h.suffix), k1 AS (SELECT {_strength("d0")} AS s),
d1 AS (SELECT domain, (good + s * above) / (n + s) AS rate FROM d0, k1),
h0 AS (SELECT name, n, good, rate AS above FROM h JOIN d1 ON h.domain = d1.domain), k2 AS (SELECT {_strength("h0")} AS s),
b AS (SELECT name, (good + s * above) / (n + s) - sqrt((good + s * above) / (n + s) * (1 - (good + s * above) / (n + s)) / (n + s + 1)) AS bound FROM h0, k2)
SELECT page_id, r.host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound >= 0.5 THEN 'allow' ELSE 'block' END AS verdict FROM r JOIN b ON r.name = b.name"""


#: Groups by the text itself.
OP11_SQL = r"""WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256 FROM d WINDOW w AS (PARTITION BY t ORDER BY size DESC, doc_id)"""

#: Counts by equality of words; products in 128 bits.
OP13_SQL = r"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM s)),
w AS (SELECT lang, a, count(*) AS f FROM t GROUP BY ALL), n AS (SELECT lang, sum(f)::BIGINT AS n FROM w GROUP BY lang),
b AS (SELECT lang, a, b, count(*) AS f FROM t WHERE b IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
x AS (SELECT lang, a, b, c, count(*) AS f FROM t WHERE c IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, a, b, max(f) AS m FROM (SELECT lang, a, b, f FROM x UNION ALL SELECT lang, b, c, f FROM x) GROUP BY ALL),
two AS (SELECT b.lang, b.a || ' ' || b.b AS phrase, b.f AS a, u.f AS l, v.f AS r, 1000000::HUGEINT * b.f * b.f // (u.f::HUGEINT * v.f) AS score FROM b JOIN w u ON u.lang = b.lang AND u.a = b.a JOIN w v ON v.lang = b.lang AND v.a = b.b
  LEFT JOIN inside i ON i.lang = b.lang AND i.a = b.a AND i.b = b.b WHERE i.m IS NULL OR 100 * i.m < 50 * b.f),
cut AS (SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c AS phrase, x.f AS a, 1 AS k, u.f AS l, v.f AS r FROM x JOIN w u ON u.lang = x.lang AND u.a = x.a JOIN b v ON v.lang = x.lang AND v.a = x.b AND v.b = x.c
  UNION ALL SELECT x.lang, x.a || ' ' || x.b || ' ' || x.c, x.f, 2, u.f, v.f FROM x JOIN b u ON u.lang = x.lang AND u.a = x.a AND u.b = x.b JOIN w v ON v.lang = x.lang AND v.a = x.c),
three AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score, row_number() OVER (PARTITION BY lang, phrase ORDER BY 1000000::HUGEINT * a * a // (l::HUGEINT * r), k) AS best FROM cut) WHERE best = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM (SELECT * FROM two UNION ALL SELECT * FROM three))
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000"""


def oracle_sql() -> dict[str, str]:
    """SQL where it can express an operator; the others are tested against brute force, the libraries or held-out labels."""
    return {"op4_vector_dedup": OP4_SQL, "op6_jaccard": OP6_SQL, "op7_urls": OP7_SQL, "op11_exact_dedup": OP11_SQL, "op13_collocations": OP13_SQL}
