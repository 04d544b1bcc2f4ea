"""Formats of the engine's own: cases read by file, exports that count from the commit on."""

import json

import pytest
from pyspark.sql import functions as F

from mnemora import schema as S
from mnemora.operators import reports
from mnemora.sources import formats

from .test_recall import memory

CASE = '[[memory]]\ncontent = "a"\ncategory = "decision"\ntags = ["t"]\n[[memory]]\ncontent = "b"\ncategory = "skill"\n[[case]]\nname = "n"\nkind = "k"\nquery = "a"\nexpect = ["a"]\n'


def test_cases(spark, tmp_path):
    formats.register(spark)
    (tmp_path / "more").mkdir()
    (tmp_path / "one.toml").write_text(CASE)
    (tmp_path / "more" / "two.toml").write_text(CASE)
    (tmp_path / "other.txt").write_text("no TOML [")
    read = lambda table, path: spark.read.format("memory_cases").option("table", table).load(str(path))
    rows = read("memory", tmp_path).orderBy("path", "ordinal").collect()
    assert [(r.path.rsplit("/", 1)[1], r.ordinal, r.content, r.tags, r.subcategory) for r in rows] == [(f, i, c, t, None) for f in ("two.toml", "one.toml") for i, c, t in ((0, "a", ["t"]), (1, "b", []))]
    assert read("case", tmp_path / "one.toml").select("name", "expect", "categories").collect() == [("n", ["a"], [])]
    assert read("case", tmp_path).rdd.getNumPartitions() == 2
    with pytest.raises(Exception, match="not one of memory, case"):
        read("neither", tmp_path).collect()
    (tmp_path / "bad.toml").write_text("no TOML [")
    with pytest.raises(Exception, match="bad.toml"):
        read("case", tmp_path).collect()


def exported(folder):
    return {p.name: "".join(f.read_text() for f in sorted(p.iterdir())) for p in folder.iterdir() if p.name.startswith("user=")}


@pytest.mark.parametrize("form", ["markdown", "json"])
def test_exports(spark, tmp_path, form):
    """Put together, a user's files are the user's document, however many tasks wrote them."""
    formats.register(spark)
    rows = spark.createDataFrame([memory(i, f"m{i}\nx", user=1 + (i % 9 == 0), tags=["t"] if i % 2 else []) for i in range(60)], S.MEMORIES)
    users = spark.createDataFrame([(1, "one"), (2, "two"), (3, "none")], "user_id long, handle string")
    order = ["user_id", *reports.PLACE]
    lines = lambda who: reports.document_lines(rows, who, form).repartitionByRange(5, *order).sortWithinPartitions(*order).select("user_id", "value")
    path = tmp_path / "out"
    lines(users).write.format("memory_export").mode("overwrite").option("suffix", "txt").save(str(path))
    whole = reports.markdown_documents(rows, users) if form == "markdown" else reports.json_documents(rows, users)
    want = {f"user={r[0]}": r[1] for r in whole.collect()}
    got = exported(path)
    assert len(list((path / "user=1").iterdir())) > 1 and (path / "_SUCCESS").exists() and not any((path / "_temporary").iterdir())
    if form == "json":
        assert {k: json.loads(v) for k, v in got.items()} == {k: json.loads(v) for k, v in want.items()}
    else:
        assert got == want
    lines(users.filter("user_id = 2")).write.format("memory_export").mode("overwrite").save(str(path))
    assert set(exported(path)) == {"user=2"}


def test_a_failed_export_changes_nothing(spark, tmp_path):
    formats.register(spark)
    path = tmp_path / "out"
    good = spark.createDataFrame([(1, "old")], "user_id long, value string")
    good.write.format("memory_export").mode("overwrite").save(str(path))
    bad = spark.range(100).select(F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") < 90, "new").otherwise(F.raise_error(F.lit("broken"))).alias("value"))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(4).write.format("memory_export").mode("overwrite").save(str(path))
    assert exported(path) == {"user=1": "old\n"}
    with pytest.raises(Exception, match="needs the columns value"):
        good.drop("value").write.format("memory_export").mode("overwrite").save(str(path))
