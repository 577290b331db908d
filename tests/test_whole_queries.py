"""Queries that give every row and whole texts."""

import os
from difflib import SequenceMatcher

import pandas as pd
import pytest

from corvane.plans import bookkeeping, ingest, retrieval

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_full_similarity(spark, monkeypatch):
    texts = ["The same  words here", "same words", "quite another text of words", "Quite an other text of word", "", "last"]
    hits = spark.createDataFrame([(1, i + 1, t) for i, t in enumerate(texts)] + [(2, 1, "alone")], "query_id long, position int, content string")
    monkeypatch.setattr(retrieval, "_hits", lambda spark, sf_dir: hits)
    got = {r["position"]: r["ratio"] for r in retrieval.d3_full(spark, "").collect()}
    flat = [" ".join(t.split()).lower() for t in texts]
    want = {1: 10 / 19, 4: 0.0, 5: 0.0}
    want |= {k: SequenceMatcher(None, *sorted((flat[k - 1], flat[k]), key=len)).ratio() for k in (2, 3)}
    assert set(got) == set(want) and got[1] == pytest.approx(want[1], abs=1e-9) and got[4] == got[5] == 0
    assert all(got[k] == pytest.approx(SequenceMatcher(None, flat[k - 1], flat[k]).ratio(), abs=1e-9) for k in (2, 3))


def test_no_row_and_no_text_is_cut(spark):
    orders = pd.read_parquet(f"{DATA}/orders.parquet")
    assert bookkeeping.k12_all(spark, DATA).count() == len(orders) > 500
    suppliers = pd.read_parquet(f"{DATA}/supplier.parquet")
    assert bookkeeping.k13_all(spark, DATA).count() == (suppliers.s_acctbal > 0).sum()
    assert ingest.t17_whole(spark, DATA).columns == ["chunk_id", "previous_md5", "next_md5"]
