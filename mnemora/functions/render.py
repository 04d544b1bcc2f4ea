"""Texts of answers for an assistant: a ranked list or a row in, a text out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import one_line


def recalled(results: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, text) for every query of ``asked``: a numbered list, best first, with category, date, score and tags, or a line that says there is none."""
    notes = F.concat_ws(", ", F.concat(F.lit("saved "), F.date_format("created_at", "yyyy-MM-dd")), F.format_string("score %.2f", "score"), F.when(F.size("tags") > 0, F.array_join("tags", ", ")))
    line = F.concat(F.col("position").cast("string"), F.lit(". ["), F.col("category"), F.lit("] "), one_line(F.col("content")), F.lit(" ("), notes, F.lit(")"))
    lines = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("ls"))
    text = F.coalesce(F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), F.lit("Nothing is stored that matches."))
    return asked.select("query_id").distinct().join(lines, "query_id", "left").select("query_id", text.alias("text"))


def bullet(memory_id: Column, category: Column, content: Column) -> Column:
    return F.concat(F.lit("- ["), category, F.lit("] "), one_line(content), F.lit(" (id "), memory_id.cast("string"), F.lit(")"))


def saved(memories: DataFrame, keys: list[str], understood: bool) -> DataFrame:
    """(keys, text) of the memories that each submission left; ``keys`` rows without any have a null memory_id."""
    return listed(memories, keys, "Nothing new was stored: it is known already, or holds nothing lasting." if understood else "Nothing was stored.", "Saved")


def distilled(memories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text) of the memories that each session left; most leave none, which is no failure."""
    return listed(memories, keys, "Nothing in this session needed keeping, as is usual.", "Kept from this session:")


def listed(memories: DataFrame, keys: list[str], none: str, head: str) -> DataFrame:
    line = bullet(F.col("memory_id"), F.col("category"), F.col("content"))
    made = memories.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("memory_id").isNotNull(), F.struct("memory_id", line.alias("line"))))).alias("ls"))
    n = F.size("ls")
    title = F.concat(F.lit(f"{head} "), n.cast("string"), F.when(n == 1, " memory").otherwise(" memories"), F.lit("\n"))
    return made.select(*keys, F.when(n == 0, none).otherwise(F.concat(title, F.array_join(F.transform("ls", lambda x: x["line"]), "\n"))).alias("text"))


def forget_candidates(memories: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): what would be deleted, and that nothing is yet."""
    made = listed(memories, keys, "Nothing matches, so nothing can be forgotten.", "Not deleted yet, to be confirmed by id:")
    return made


def forgotten(n: Column) -> Column:
    """How many memories were deleted; missing and foreign ids are not told apart."""
    return F.when(n == 0, "No memory was deleted.").otherwise(F.concat(F.lit("Deleted "), n.cast("string"), F.when(n == 1, " memory.").otherwise(" memories.")))
