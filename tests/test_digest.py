"""Digests that are taken up again by task after task."""

import hashlib

import pytest
from pyspark.sql import functions as F

from mnemora.functions import digest
from mnemora.operators import reports
from mnemora.plans import fixtures as X
from mnemora.plans.queries import users


@pytest.mark.parametrize("way", [digest.plain, digest.compress])
def test_in_parts(monkeypatch, way):
    monkeypatch.setattr(digest, "compress", way)
    for sizes in ([], [0], [1], [55], [56], [63, 1], [64], [65, 700, 3], [119, 9], [1000, 0, 24]):
        state, whole = digest.START, b""
        for i, n in enumerate(sizes):
            part = bytes((i + j * 7) % 256 for j in range(n))
            state, whole = digest.more(state, part), whole + part
        assert digest.closed(state) == hashlib.md5(whole).hexdigest()


@pytest.mark.parametrize("most", [30_000, 1 << 27])
def test_documents_in_pieces(spark, tmp_path, most):
    """The digests of documents that no task sees whole."""
    rows, who = X.memories(spark, "/root/testdata/sf0.001"), users(spark, None)
    want = {r.user_id: r.d for r in reports.markdown_documents(rows, who, True).select("user_id", F.md5(F.col("text").cast("binary")).alias("d")).collect()}
    path = str(tmp_path / "digests")
    got = reports.document_digests(reports.document_lines(rows, who, "markdown", True), path, most)
    assert {r.user_id: r.digest for r in got.collect()} == want
    pieces = spark.read.parquet(f"{path}/pieces").groupBy("user_id", "piece").agg(F.sum(F.octet_length("value") + 1).alias("n")).collect()
    assert (max(r.piece for r in pieces) > 0) == (most < 1 << 27) and max(r.n for r in pieces) < max(most, 1 << 17) + 200_000
