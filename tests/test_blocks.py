"""Block postings against the plain keyword leg, and how much of a skewed corpus is read."""

import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators import blocks, recall
from mnemora.plans.queries import QUERIES

WEIGHT = "user_id long, memory_id long, term string, weight double"


def corpus(r, n=3000):
    """A user most of whose memories have one term, another with few memories; rare terms weigh more."""
    rows = [(1, i, "the", round(0.05 + (i % 97) / 1000, 9)) for i in range(n)]
    for term, share, weight in (("often", 5, 1.0), ("seldom", 100, 4.0), ("rare", 700, 7.0)):
        rows += [(1, i, term, round(weight * (0.5 + r.random()), 9)) for i in range(n) if i % share == 1]
    return rows + [(2, i, t, 1.0) for i in range(30) for t in ("the", "rare")[: 1 + i % 2]]


@pytest.mark.parametrize("block", [128, 3])
def test_same_answers(spark, monkeypatch, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    weights = spark.createDataFrame(corpus(random.Random(3), 900), WEIGHT)
    asked = [(1, 1, "the", 5), (2, 1, "the rare", 4), (3, 1, "often seldom the the", 30), (4, 2, "rare the", 20), (5, 2, "nothing", 5), (6, 1, "rare", 200), (7, 3, "the", 5), (8, 1, "seldom often rare the", 1)]
    queries = spark.createDataFrame(asked, "query_id long, user_id long, text string, depth long")
    got = blocks.keyword_leg(queries, blocks.blocks(weights))
    want = recall.keyword_leg(queries, None, 0, weights)
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_frequent_term_is_read_in_part(spark):
    """Of 3000 postings of a stop word a query by itself reads a few blocks; beside a rare word none brings a candidate."""
    made = blocks.blocks(spark.createDataFrame(corpus(random.Random(3)), WEIGHT))
    assert made.filter("term = 'the' AND user_id = 1").agg(F.max("n")).first()[0] <= 2 * blocks.BLOCK
    alone = blocks.Plan(spark.createDataFrame([(1, 1, "the", 20)], "query_id long, user_id long, text string, depth long"), made, 0)
    assert blocks.read(made, alone.second).count() < 700
    beside = blocks.Plan(spark.createDataFrame([(1, 1, "the seldom", 20)], "query_id long, user_id long, text string, depth long"), made, 0)
    assert [r.term for r in beside.probed.collect()] == ["the"] and beside.candidates().count() <= 30


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_where_memories_are_read(spark):
    """Postings shuffle nothing, and the weights for a small batch leave them where they are."""
    rows = [(1, i, "a b b c " * i + "É é", ["b", "x"], "decision") for i in range(4)] + [(2, 9, "", None, None)]
    memories = spark.createDataFrame(rows, "user_id long, memory_id long, content string, tags array<string>, category string")
    got = {(r.memory_id, r.field, r.term): (r.tf, r.dl) for r in recall.postings(memories).collect()}
    assert got[3, "content", "b"] == (6, 14) and got[3, "content", "é"] == (2, 14) and got[0, "tags", "x"] == (1, 2) and not [k for k in got if k[0] == 9]
    assert len(got) == 4 * 3 + 3 * 3 + 4
    assert "Exchange" not in plan(recall.postings(memories))
    asked = spark.createDataFrame([(7, 1, 5, "b")], "query_id long, user_id long, depth long, term string")
    assert "memory_id" not in "".join(line for line in plan(recall.weights_for(asked, memories, 1000)).split("\n") if "Exchange hashpartitioning" in line)


@pytest.mark.parametrize("name", ["rrf_fuse", "recall_text", "recall_filtered_post", "neighbours_shown"])
def test_recall_gathers_no_postings(spark, name):
    """F18 to F21: no shuffle of a recall query is keyed by a memory's terms, which made the largest task's memory grow with the text."""
    keys = [line for line in plan(QUERIES[name](spark, "/root/testdata/sf0.001")).split("\n") if "Exchange hashpartitioning" in line]
    assert [k for k in keys if "query_id" in k and "memory_id" in k] and not [k for k in keys if "memory_id" in k and "term" in k]


def test_blocks_are_made_once(spark, tmp_path):
    made = blocks.write(blocks.blocks(spark.createDataFrame(corpus(random.Random(3), 300), WEIGHT)), str(tmp_path / "blocks"))
    assert "Exchange" not in plan(made) and made.agg(F.sum("n")).first()[0] == len(corpus(random.Random(3), 300))
