"""Score expressions. Every time-dependent one takes ``now`` as a column or literal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def age_days(since: Column, now: Column) -> Column:
    """Whole seconds from ``since`` to ``now`` in days; the future counts as now."""
    seconds = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / 1_000_000)
    return F.greatest(seconds, F.lit(0)) / F.lit(86400.0)


def recency(created_at: Column, now: Column, half_life: float = S.HALF_LIFE_DAYS) -> Column:
    """0.8 to 1, halving towards the floor every ``half_life`` days; 0 means no decay."""
    if half_life <= 0:
        return F.lit(1.0)
    return S.SCORE_FLOOR + (1 - S.SCORE_FLOOR) * clamp(F.pow(F.lit(0.5), age_days(created_at, now) / half_life))


def quality(confidence: Column, importance: Column) -> Column:
    """0.8 to 1 by confidence x importance, which share one band."""
    return S.SCORE_FLOOR + (1 - S.SCORE_FLOOR) * clamp(confidence * importance)


def fused(*ranks: Column) -> Column:
    """Reciprocal-rank fusion; an absent rank adds nothing."""
    out = F.lit(0.0)
    for r in ranks:
        out = out + F.coalesce(F.lit(1.0) / (S.RRF_K + r), F.lit(0.0))
    return out


def importance(created_at: Column, last_accessed_at: Column, access_count: Column, now: Column) -> Column:
    """From the floor to 1: half by time since the last access (or creation), half by how often."""
    idle = F.pow(F.lit(0.5), age_days(F.coalesce(last_accessed_at, created_at), now) / S.IMPORTANCE_HALF_LIFE)
    used = 1 - F.pow(F.lit(0.5), F.coalesce(access_count, F.lit(0)) / S.IMPORTANCE_SATURATION)
    return S.IMPORTANCE_FLOOR + (1 - S.IMPORTANCE_FLOOR) * clamp(0.5 * idle + 0.5 * used)


def candidate_depth(limit: Column) -> Column:
    """Candidates taken from each leg for a limit."""
    return F.least(F.greatest(4 * F.least(limit, F.lit(S.MAX_LIMIT)), F.lit(S.MIN_DEPTH)), F.lit(S.MAX_DEPTH))


def backoff_seconds(attempts: Column) -> Column:
    """Wait before the next attempt: 5 s, doubled per earlier attempt, at most 64 times."""
    return (S.BACKOFF_SECONDS * F.pow(F.lit(2.0), F.least(F.greatest(attempts - 1, F.lit(0)), F.lit(6)))).cast("long")


#: Kinds of errors after which a job is worth another attempt.
RETRYABLE = ("internal", "conflict")


def retryable(kind: Column) -> Column:
    return kind.isin(*RETRYABLE)


#: HTTP answers below 500 after which a model call is worth repeating.
TRANSIENT = (408, 409, 429)


def transient_status(status: Column) -> Column:
    """HTTP answers after which a model call is worth repeating."""
    return F.coalesce((status >= 500) | status.isin(*TRANSIENT), F.lit(False))


def error_kind(status: Column) -> Column:
    """The kind of error that an HTTP answer is to a job: what is worth repeating is ``internal``, the rest ``validation``; null for a good answer."""
    return F.when(status < 300, None).otherwise(F.when(transient_status(status), "internal").otherwise("validation"))
