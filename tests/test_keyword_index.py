"""The kept index against scoring everything: scopes, deltas, deletions, compaction, block bounds."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import search
from corvane.operators.keyword_index import KeywordIndex, bucket_of
from corvane.schemas import Scope
from corvane.storage import Versioned

COLUMNS = "workspace_id string, knowledge_base_id string, doc_id string, seq int, chunk_id string, content string"
WORDS = [f"w{i}" for i in range(60)]


def document(doc, base, seed, n=40):
    rng = random.Random(seed)
    return [("a" if base != "k3" else "b", base, doc, s, f"{doc}::{s}", " ".join(rng.choices(WORDS, [1 / (i + 1) for i in range(60)], k=rng.randint(0, 30)))) for s in range(n)]


QUERIES = [(i, " ".join(random.Random(100 + i).sample(WORDS, 1 + i % 5))) for i in range(12)] + [(50, ""), (51, "unknown"), (52, None)]


def exhaustive(spark, rows, keep=lambda r: True, k=5):
    """Every chunk scored with the statistics of all, then those that may be shown ranked."""
    chunks = spark.createDataFrame(rows, COLUMNS)
    scored = search.bm25_scores(chunks, spark.createDataFrame(QUERIES, "query_id long, text string"))
    shown = spark.createDataFrame([(r[4],) for r in rows if keep(r)], "chunk_id string")
    best = search.top_k(scored.join(shown, "chunk_id", "left_semi"), k, "bm25")
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["bm25"], 8)) for r in best.collect())


def found(spark, index, scope=None, k=5):
    hits = index.search(spark.createDataFrame(QUERIES, "query_id long, text string"), k, scope)
    return sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["bm25"], 8)) for r in hits.collect())


@pytest.fixture(scope="module")
def corpus():
    return sum((document(f"d{i}", f"k{i % 4}", i) for i in range(20)), [])


def test_equals_scoring_everything_in_every_state(spark, corpus, tmp_path):
    store = Versioned(spark, f"file://{tmp_path}/index")
    index = KeywordIndex(store, buckets=4)
    assert found(spark, index) == []
    first = [r for r in corpus if r[2] not in ("d18", "d19")]
    index.add(spark.createDataFrame(first, COLUMNS), "first")
    assert store.table("gone") is None
    assert found(spark, index) == exhaustive(spark, first)
    scope = Scope("a", ("k1", "k2"))
    assert found(spark, index, scope) == exhaustive(spark, first, lambda r: r[1] in ("k1", "k2") and r[0] == "a")
    one = Scope("a", ("k1", "k2"), ("d2", "d5"))
    assert found(spark, index, one) == exhaustive(spark, first, lambda r: r[2] in ("d2", "d5"))
    # another segment, which also replaces a document; the same name once more changes nothing
    again = document("d3", "k3", 99, 7)
    late = [r for r in corpus if r[2] in ("d18", "d19")] + again
    for _ in range(2):
        index.add(spark.createDataFrame(late, COLUMNS), "second")
    assert store.version == 2
    now = [r for r in first if r[2] != "d3"] + late
    assert found(spark, index) == exhaustive(spark, now)
    index.delete(spark.createDataFrame([("d0",), ("absent",)], "doc_id string"))
    now = [r for r in now if r[2] != "d0"]
    assert found(spark, index, scope) == exhaustive(spark, now, lambda r: r[1] in ("k1", "k2") and r[0] == "a")
    df = {r["term"]: (r["df"], r["total"]) for r in index.totals().collect()}
    want = {}
    for r in now:
        for t in set(r[5].split()):
            d, n = want.get(t, (0, 0))
            want[t] = d + 1, n + r[5].split().count(t)
    assert df == want
    index.compact()
    assert store.table("gone") is None
    assert found(spark, index) == exhaustive(spark, now)
    assert {r["term"]: (r["df"], r["total"]) for r in index.totals().collect()} == want
    # an earlier version can still be read
    assert found(spark, KeywordIndex(Versioned(spark, f"file://{tmp_path}/index", version=1), 4)) == exhaustive(spark, first)


def test_reads_the_terms_partitions(spark, tmp_path):
    """A rare word in one document stands in one block; its partition alone is read."""
    rows = [("a", "k", f"d{i}", 0, f"d{i}", "common " * (1 + i % 7) + f"filler{i}") for i in range(3000)]
    rows += [("a", "k", "rare", s, f"rare{s}", f"common needle extra{s}") for s in range(6)]
    index = KeywordIndex(Versioned(spark, f"file://{tmp_path}/x"), buckets=4)
    index.add(spark.createDataFrame(rows, COLUMNS))
    asked = spark.createDataFrame([(1, "common needle")], "query_id long, text string")
    hits = index.search(asked, 5)
    assert {r["chunk_id"][:4] for r in hits.collect()} == {"rare"}
    terms = spark.createDataFrame([("needle",)], "term string").withColumn("bucket", bucket_of(F.col("term"), 4))
    read = index._asked_blocks(terms)
    filters = read._jdf.queryExecution().toString().split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "bucket#" in filters
    assert read.count() == 1 and read.first()["n"] == 6


def test_a_failed_writer_leaves_no_version(spark, tmp_path):
    store = Versioned(spark, f"file://{tmp_path}/s")
    rows = spark.range(3)
    store.commit({"t": store.write(rows, "t")}, "one")
    store.write(rows, "t")  # written, never committed
    assert Versioned(spark, f"file://{tmp_path}/s").table("t").count() == 3
    with pytest.raises(ValueError):
        store.commit({"t": store.write(rows, "t")}, "one")
    other = Versioned(spark, f"file://{tmp_path}/s")
    store.commit({"t": store.write(rows, "t")}, "two")
    with pytest.raises(RuntimeError):
        other.commit({"t": other.write(rows, "t")}, "three")
    assert Versioned(spark, f"file://{tmp_path}/s").table("t").agg(F.count(F.lit(1))).first()[0] == 6


def test_chunks_are_kept_without_an_index_and_blocks_without_a_sort(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    from corvane.plans import adapters

    sorts = []
    for name in ("sortWithinPartitions", "repartition", "sort", "orderBy"):
        plain = getattr(DataFrame, name)
        monkeypatch.setattr(DataFrame, name, lambda self, *a, name=name, plain=plain, **k: (sorts.append((name, "entries" in self.columns)), plain(self, *a, **k))[1])
    monkeypatch.setattr(adapters, "_kept", {})
    sf_dir = "/root/testdata/sf0.001"
    assert adapters.kept_chunks(spark, sf_dir).count() == adapters.chunks(spark, sf_dir).count()
    assert not [k for k in adapters._kept if "index" in k]
    open_before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    index = adapters.kept_index(spark, sf_dir)
    assert not [name for name, wide in sorts if wide] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == open_before
    assert index.store.table("chunks").count() == adapters.kept_chunks(spark, sf_dir).count() and index.totals().count() > 0


def test_totals_after_replacements_read_no_postings(spark, tmp_path):
    """df and total are sums over blocks, less those of the chunks that are gone; of some scopes too."""
    index = KeywordIndex(Versioned(spark, f"file://{tmp_path}/index"), 4)
    corpus = [r for i in range(12) for r in document(f"d{i}", f"k{i % 3}", i, 5)]
    index.add(spark.createDataFrame(corpus, COLUMNS))
    late = document("d3", "k1", 50, 4) + document("d4", "k1", 51, 2)
    index.add(spark.createDataFrame(late, COLUMNS))
    index.delete(spark.createDataFrame([("d7",), ("d0",)], "doc_id string"))
    for where in (None, F.col("knowledge_base_id") != "k2", F.col("knowledge_base_id") == "none"):
        got = index.totals(where)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "entries" not in plan and "Window" not in plan
        rows = index.postings() if where is None else index.postings().where(where)
        want = rows.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("total"))
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
