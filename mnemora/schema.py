"""The memory model: columns, categories, default constants."""

from __future__ import annotations

from pyspark.sql import types as T

#: The built-in categories in taxonomy order, then those a profile shows, in its order, with headings.
CATEGORIES = ("preference.coding", "preference.personal", "decision", "fact.project", "fact.person", "experience", "skill", "reference")
PROFILE_ORDER = {
    "preference.coding": "Coding preferences",
    "preference.personal": "Personal preferences",
    "decision": "Decisions",
    "fact.project": "Project facts",
    "fact.person": "People",
    "skill": "Skills",
    "experience": "Experiences",
    "reference": "References",
}
PERSONAL = ("preference.personal", "fact.person")
DEFAULT_CATEGORY = "fact.project"

#: Default limits and constants of recall, decay, profiles and jobs.
MAX_CONTENT, MAX_QUERY, MAX_TAG, MAX_TAGS, MAX_TRANSCRIPT = 4000, 1000, 64, 32, 200_000
DEFAULT_LIMIT, MAX_LIMIT, MIN_DEPTH, MAX_DEPTH = 8, 50, 20, 200
RRF_K, SCORE_FLOOR, HALF_LIFE_DAYS = 60, 0.8, 90.0
IMPORTANCE_FLOOR, IMPORTANCE_HALF_LIFE, IMPORTANCE_SATURATION = 0.35, 90.0, 5.0
SIMILARITY, GROUP_CAP, NEIGHBOURS, DIGEST_ROWS = 0.92, 2000, 5, 200
PROFILE_ROWS, PROFILE_BYTES = 8, 6000
JOB_ATTEMPTS, BACKOFF_SECONDS, STALE_MINUTES = 3, 5, 15
BM25_K1, BM25_B = 1.2, 0.75

ENTITY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("kind", T.StringType())]))

MEMORIES = T.StructType(
    [
        T.StructField("memory_id", T.LongType(), False),
        T.StructField("user_id", T.LongType(), False),
        T.StructField("content", T.StringType()),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("entities", ENTITY),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("client", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("updated_at", T.TimestampNTZType()),
        T.StructField("last_accessed_at", T.TimestampNTZType()),
        T.StructField("access_count", T.LongType()),
        T.StructField("importance", T.DoubleType()),
        T.StructField("expires_at", T.TimestampNTZType()),
        T.StructField("superseded_by", T.LongType()),
        T.StructField("deleted_at", T.TimestampNTZType()),
    ]
)
