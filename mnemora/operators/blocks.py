"""BM25 top-k from blocks of postings with a stored maximum each: terms that very many memories have are not read whole.

The postings of a term are cut by weight into levels, and a level into blocks. A first pass scores the best blocks of each
term: the ``depth``-th best sum so far is a bound that every answer must reach. Terms that cannot reach it together, even at
their maxima, bring no candidates; the others bring those of the blocks that still can; and the former terms are looked up
for these candidates alone. The answer is that of all postings, ties included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from . import recall

#: Postings of a block, about, and levels to a unit of weight.
BLOCK, LEVELS = 128, 8
#: Scores are rounded to six digits, so a bound that is missed by no more than this may be reached.
MARGIN = 2e-6
ASKED = ["query_id", "user_id", "depth"]
PLACE = ["user_id", "term", "level", "part"]


def blocks(weights: DataFrame) -> DataFrame:
    """(user_id, term, level, part, top, n, postings array<struct<memory_id, weight>>) from an index's term weights.

    A level with more than BLOCK postings is dealt by their memories into as many parts as that takes, so no key is gathered whole.
    """
    rows = weights.withColumn("level", F.floor(F.col("weight") * LEVELS).cast("int"))
    large = rows.groupBy("user_id", "term", "level").agg(F.count("*").alias("_n")).filter(F.col("_n") > BLOCK)
    dealt = rows.join(large, ["user_id", "term", "level"], "left")
    part = F.pmod(F.xxhash64("memory_id"), F.ceil(F.coalesce("_n", F.lit(1)) / BLOCK)).cast("int")
    return dealt.withColumn("part", part).groupBy(*PLACE).agg(F.max("weight").alias("top"), F.count("*").alias("n"), F.collect_list(F.struct("memory_id", "weight")).alias("postings"))


def write(made: DataFrame, path: str) -> DataFrame:
    """``blocks`` written to a new path and read back: a batch of queries reads them several times, and they are made once."""
    made.sortWithinPartitions(*PLACE).write.parquet(path)
    return made.sparkSession.read.parquet(path)


def read(made: DataFrame, chosen: DataFrame) -> DataFrame:
    """The postings of chosen blocks (PLACE and further columns), a row each."""
    met = made.select(*PLACE, "postings").join(chosen, PLACE)
    return met.select(*chosen.columns, F.explode("postings").alias("p")).select(*chosen.columns, "p.memory_id", "p.weight")


class Plan:
    """What a batch of queries (query_id, user_id, text, depth) reads of ``made``: ``first`` (the best blocks), ``bound`` a
    query, ``second`` (blocks that can still matter) and ``probed`` (terms that are looked up for candidates only).
    """

    def __init__(self, queries: DataFrame, made: DataFrame, size: int) -> None:
        asked = queries.select(*ASKED, F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        heads = made.drop("postings").join(recall.small(asked, size), ["user_id", "term"])
        best = Window.partitionBy(*ASKED, "term").orderBy(F.col("top").desc(), "level", "part").rowsBetween(Window.unboundedPreceding, -1)
        before = F.coalesce(F.sum("n").over(best), F.lit(0))
        self.made = made
        self.first = heads.withColumn("before", before).filter(F.col("before") < F.col("depth")).drop("before")
        seen = read(made, self.first.select(*PLACE, "query_id", "depth")).groupBy(*ASKED, "memory_id").agg(F.sum("weight").alias("sum"))
        nth = Window.partitionBy(*ASKED).orderBy(F.col("sum").desc())
        ranked = seen.withColumn("at", F.row_number().over(nth)).filter(F.col("at") <= F.col("depth")).filter("at <= 200")
        bound = ranked.groupBy(*ASKED).agg(F.min("sum").alias("least"), F.count("*").alias("got"))
        self.bound = bound.select(*ASKED, F.when(F.col("got") >= F.least("depth", F.lit(200)), F.col("least") - MARGIN).otherwise(0.0).alias("bound"))
        # a query's terms from the weakest on: those whose maxima do not reach the bound together are looked up last
        most = heads.groupBy(*ASKED, "term").agg(F.max("top").alias("most"))
        rising = Window.partitionBy(*ASKED).orderBy("most", "term")
        terms = most.join(self.bound, ASKED).withColumns({"reach": F.sum("most").over(rising), "all": F.sum("most").over(Window.partitionBy(*ASKED))})
        self.terms = terms.withColumn("probed", F.col("reach") < F.col("bound"))
        self.probed = self.terms.filter("probed").select(*ASKED, "term", "bound")
        can = heads.join(self.terms.filter("not probed").select(*ASKED, "term", "most", "all", "bound"), [*ASKED, "term"])
        self.second = can.filter(F.col("top") + F.col("all") - F.col("most") >= F.col("bound")).select(*PLACE, "query_id", "depth", "bound")

    def candidates(self) -> DataFrame:
        """(query_id, user_id, depth, memory_id, sum) of memories that can still reach the bound."""
        rest = self.terms.groupBy(*ASKED).agg(F.sum(F.when(F.col("probed"), F.col("most")).otherwise(0.0)).alias("rest"))
        sums = read(self.made, self.second).groupBy(*ASKED, "memory_id", "bound").agg(F.sum("weight").alias("sum"))
        return sums.join(rest, ASKED).filter(F.col("sum") + F.col("rest") >= F.col("bound")).select(*ASKED, "memory_id", "sum")

    def hits(self) -> DataFrame:
        found = self.candidates()
        wide = self.made.select("user_id", "term", "postings").join(self.probed.select(*ASKED, "term"), ["user_id", "term"])
        more = wide.select(*ASKED, F.explode("postings").alias("p")).select(*ASKED, F.col("p.memory_id").alias("memory_id"), F.col("p.weight").alias("weight"))
        added = more.join(found.select(*ASKED, "memory_id"), [*ASKED, "memory_id"], "left_semi").select(*ASKED, "memory_id", F.col("weight").alias("sum"))
        return found.unionByName(added).groupBy(*ASKED, "memory_id").agg(F.round(F.sum("sum"), 6).alias("bm25"))


def keyword_leg(queries: DataFrame, made: DataFrame, size: int = 0) -> DataFrame:
    """What ``recall.keyword_leg`` gives, from ``blocks``."""
    hits = Plan(queries, made, size).hits().filter("bm25 > 0")
    return recall.ranked(hits, [F.col("bm25").desc(), F.col("memory_id")], "keyword_rank").select("query_id", "user_id", "memory_id", "keyword_rank", "bm25")
