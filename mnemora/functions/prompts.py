"""What a caller's model is asked: one text a row, from columns alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from .text import one_line

SHAPES = {
    "extract": '{"candidates": [{"content": text, "category": name, "subcategory": text or null, "tags": [text], "entities": [{"name": text, "kind": text}], "confidence": 0 to 1}]}',
    "reconcile": '{"decisions": [{"action": "ADD", "UPDATE", "DELETE" or "NOOP", "memory_id": id or null, "reason": text}]}',
    "merge": '{"merge": true or false, "content": text, "category": name, "tags": [text], "reason": text}',
    "digest": '{"digest": text}',
}
#: What an extraction looks for: lasting facts of a message, or what a whole session taught.
LENSES = {
    "message": "List the facts, preferences and decisions in this message that stay true after the conversation.",
    "session": "List what this session established that later sessions need: decisions and their reasons, causes that were found, conventions.",
}


def closing(kind: str) -> Column:
    return F.lit(f"\n\nAnswer with JSON of this shape only: {SHAPES[kind]}")


def names(extras: tuple[str, ...] = ()) -> str:
    return ", ".join((*S.CATEGORIES, *extras))


def extraction(content: Column, lens: str = "message", extras: tuple[str, ...] = ()) -> Column:
    return F.concat(F.lit(f"{LENSES[lens]}\nCategories: {names(extras)}\n\n"), content, closing("extract"))


def reconciliation(candidate: Column, shown: Column) -> Column:
    """``shown`` is array<struct<memory_id, content>> of the neighbours."""
    lines = F.transform(shown, lambda m: F.concat(F.lit("- "), m["memory_id"].cast("string"), F.lit(": "), one_line(m["content"])))
    stored = F.when(F.size(shown) > 0, F.array_join(lines, "\n")).otherwise("(none)")
    return F.concat(F.lit("New fact: "), one_line(candidate), F.lit("\nStored memories near it:\n"), stored, F.lit("\n\nIs it new, does it replace or refute one of them, or is it known?"), closing("reconcile"))


def merge(members: DataFrame) -> DataFrame:
    """(user_id, cluster_id, prompt) from the memories of each cluster, in id order."""
    tags = F.when(F.size("tags") > 0, F.array_join("tags", ", ")).otherwise("(none)")
    entry = F.concat(F.lit("\n["), F.col("category"), F.lit("; "), tags, F.lit("; "), F.date_format("created_at", "yyyy-MM-dd"), F.lit("]\n"), one_line(F.col("content")), F.lit("\n"))
    rows = members.groupBy("user_id", "cluster_id").agg(F.array_sort(F.collect_list(F.struct("memory_id", entry.alias("e")))).alias("es"))
    head = F.concat(F.size("es").cast("string"), F.lit(" memories that may say the same thing:\n"))
    body = F.array_join(F.transform("es", lambda x: x["e"]), "")
    ask = F.lit("\nIf they do, write the one memory that replaces them without losing a detail; if not, keep them.")
    return rows.select("user_id", "cluster_id", F.concat(head, body, ask, closing("merge")).alias("prompt"))


def digest(rows: DataFrame, words: int = 300) -> DataFrame:
    """(user_id, domain, prompt) from the rows that ``reports.digest_rows`` selects, in their order."""
    line = F.concat(F.lit("- ["), F.col("category"), F.lit("] "), one_line(F.col("content")))
    parts = rows.groupBy("user_id", "domain").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("ls"))
    head = F.concat(F.lit(f"Describe this person in at most {words} words, from their "), F.col("domain"), F.lit(" memories alone; give an empty text if they say nothing.\n"))
    return parts.select("user_id", "domain", F.concat(head, F.array_join(F.transform("ls", lambda x: x["line"]), "\n"), closing("digest")).alias("prompt"))
