"""Score expressions: bounds, ties and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.functions import scores
from mnemora.functions import text as T
from mnemora.functions import vectors as V

def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def before(days):
    return now() - F.make_dt_interval(days=F.lit(days))


def test_recency_is_bounded_and_halves(spark):
    got = one(spark, *(scores.recency(before(d), now()) for d in (0, 90, 180, 100_000)), scores.recency(before(-5), now()), scores.recency(before(9), now(), 0))
    assert list(got) == pytest.approx([1.0, 0.9, 0.85, 0.8, 1.0, 1.0])


def test_quality_shares_one_band(spark):
    got = one(spark, scores.quality(F.lit(1.0), F.lit(1.0)), scores.quality(F.lit(0.0), F.lit(1.0)), scores.quality(F.lit(0.5), F.lit(0.5)), scores.quality(F.lit(9.0), F.lit(1.0)))
    assert list(got) == pytest.approx([1.0, 0.8, 0.85, 1.0])


def test_fusion_rewards_agreement(spark):
    none = F.lit(None).cast("long")
    both, left, right, nothing = one(spark, scores.fused(F.lit(5), F.lit(5)), scores.fused(F.lit(1), none), scores.fused(none, F.lit(1)), scores.fused(none, none))
    assert both > left == right == pytest.approx(1 / 61) and nothing == 0


def test_decay_never_leapfrogs_twenty_ranks(spark):
    """The lowest multiplier of the first rank still beats the highest of the rank 50 below, and floors hold."""
    low = S.SCORE_FLOOR**2 / (S.RRF_K + 1)
    assert low > 1 / (S.RRF_K + 1 + 50)


@pytest.mark.parametrize(("days", "n", "want"), [(0, 0, 0.35 + 0.65 * 0.5), (90, 0, 0.35 + 0.65 * 0.25), (100_000, 0, 0.35), (0, 5, 0.35 + 0.65 * 0.75), (0, 10**6, 1.0)])
def test_importance_grid(spark, days, n, want):
    assert one(spark, scores.importance(before(days), F.lit(None).cast("timestamp_ntz"), F.lit(n), now()))[0] == pytest.approx(want, abs=1e-9)


def test_importance_monotone(spark):
    rows = [one(spark, scores.importance(before(400), before(d), F.lit(n), now()))[0] for d, n in ((0, 1), (10, 1), (10, 0), (300, 0))]
    assert rows == sorted(rows, reverse=True) and rows[-1] >= S.IMPORTANCE_FLOOR


def test_backoff_and_depth(spark):
    got = one(spark, *(scores.backoff_seconds(F.lit(a)) for a in (0, 1, 2, 3, 7, 50)), *(scores.candidate_depth(F.lit(k)) for k in (1, 8, 50, 500)))
    assert list(got) == [5, 5, 10, 20, 320, 320, 20, 32, 200, 200]
    assert list(one(spark, *(scores.transient_status(F.lit(s)) for s in (500, 429, 408, 409, 404, 200)))) == [True] * 4 + [False] * 2
    assert list(one(spark, *(scores.retryable(F.lit(k)) for k in ("internal", "conflict", "validation")))) == [True, True, False]


def test_cosine_edges(spark):
    arr = lambda *x: F.array(*map(F.lit, x)).cast("array<double>")
    got = one(spark, V.cosine(arr(1, 0), arr(2, 0)), V.cosine(arr(1, 0), arr(-1, 0)), V.cosine(arr(1, 0), arr(0, 1)), V.cosine(arr(0, 0), arr(1, 0)), V.cosine(arr(1, 0), arr(1, 0, 0)), V.cosine(arr(), arr()), V.l2_distance(arr(0, 3), arr(4, 0)))
    assert list(got) == pytest.approx([1, -1, 0, 0, 0, 0, 5])
    unit = one(spark, V.l2_normalise(arr(3, 4)), V.l2_normalise(arr(0, 0)))
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0, 0] and not math.isnan(unit[1][0])


def test_text_rules(spark):
    tags = F.array(F.lit(" TypeScript "), F.lit("typescript"), F.lit(""), F.lit(None), F.lit("É"))
    got = one(spark, T.normalise_tags(tags), T.normalise_subcategory(F.lit("  ")), T.normalise_subcategory(F.lit(" Ab ")), T.escape_query(F.lit('a+b "c:d"  (e)/')), T.tokens(F.lit("useQuery, é_1 " + "x" * 40)))
    assert got[0] == ["typescript", "É"] and got[1] is None and got[2] == "ab" and got[3] == "a b c d e" and got[4] == ["usequery", "é", "1"]
    got = one(spark, *(T.resolve_category(F.lit(x)) for x in (" Decision", "preference.food", "fact.person", "xyz", None)), T.resolve_category(F.lit("custom"), ("custom",)))
    assert [(r.category, r.exact) for r in got] == [("decision", True), ("preference.coding", False), ("fact.person", True), ("fact.project", False), ("fact.project", False), ("custom", True)]
    got = one(spark, *(T.infer_category(F.lit(x)) for x in ("We decided and I prefer", "I ALWAYS test", "plain")))
    assert list(got) == ["decision", "preference.coding", "fact.project"]
    got = one(spark, *(T.reject_reason(F.lit(x)) for x in ("", " \n ", "x" * 4000, "x" * 4001)), T.reject_reason(F.lit("a"), F.array(F.lit("y" * 65))), T.reject_reason(F.lit("a"), F.array_repeat(F.lit("t"), 33)))
    assert list(got) == ["content is empty", "content is empty", None, "content is too long", "tag is too long", "too many tags"]
    got = one(spark, *(T.valid_email(F.lit(x)) for x in ("a@b", "@b", "a@", "ab")), *(T.valid_handle(F.lit(x)) for x in ("Al-ex_1.b", "a b", "")), T.scopes(F.lit("write, READ,write,zzz")))
    assert list(got[:7]) == [True, False, False, False, True, False, False] and got[7] == ["read", "write"]
    got = one(spark, T.allows(F.array(F.lit("write")), "read"), T.allows(F.array(F.lit("admin")), "read"), T.api_key_parts(F.lit("k_" + "0a" * 20), "k_"), T.api_key_parts(F.lit("k_zz"), "k_"), T.unit_interval(F.lit(float("nan")), 1.0), T.unit_interval(F.lit(7.0), 1.0))
    assert list(got[:2]) == [False, True] and got[2].prefix == "0a0a0a0a" and got[3] is None and list(got[4:]) == [1.0, 1.0]
