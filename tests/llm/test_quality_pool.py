"""Co-training learns from every unlabelled row, wherever it lies."""

import numpy as np
from pyspark.sql import functions as F

from corvane.llm import quality


def views(n, seed):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n).astype(float)
    return y, tuple(((y[:, None] * 2 - 1) + rng.normal(0, 0.7, (n, 3))).astype(np.float16).astype(np.float32) for _ in range(2))


def test_far_pool_gives_the_sums_of_a_near_one(spark):
    y, (a, b) = views(3000, 4)
    rows = [(np.concatenate([a[i], b[i]]).astype(np.float16).tobytes(),) for i in range(40, 3000)]
    far = quality.FarPool(spark.createDataFrame(rows, "x binary").repartition(5), (3, 3))
    few = slice(0, 40)
    near = quality.co_train((a[few], b[few]), y[few], (a[40:], b[40:]))
    assert all(np.allclose(x, z, atol=1e-8) for x, z in zip(near, quality.co_train((a[few], b[few]), y[few], far), strict=True))


def test_pseudo_labels_come_from_the_whole_pool_in_proportion():
    counts = np.zeros(quality.BINS)
    counts[-300:], counts[:300], counts[2000:2100] = 100, 50, 7
    up, down = quality.chosen(counts, 0.25, 1.0)
    n_up, n_down = (up * counts).sum(), (down * counts).sum()
    assert n_down == 15_000 and abs(n_up - 5_000) < 1e-6 and up[-50:].all() and not up[:-51].any()
    up, down = quality.chosen(counts * 1000, 0.25, 0.2)
    assert abs((down * counts * 1000).sum() - 3_000_000) < 1e-3  # a share of the pool, not a fixed number


def test_all_unlabelled_rows_are_kept(spark):
    rows = [(i, f"word{i % 9} text", "en", "s", 1) for i in range(15_000)] + [(None, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id < 1000").select("doc_id", F.lit(1).alias("quality"))
    assert quality._pool(docs, labels, "doc_id", "text", ("source", "lang", "n_chars")).count() == 14_000
