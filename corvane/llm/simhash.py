"""SimHash near-duplicates, linked exactly within a Hamming radius through vantage-point trees.

1. Fingerprint: every bit is the majority of that bit over the hashes of all word shingles of the whole text.
2. Equal fingerprints are one class, so copies cost nothing further.
3. A routing tree of vantage points is built on a bounded sample of classes (`SAMPLE`): each node splits fingerprints by their
   Hamming distance to its vantage point. Two fingerprints within `radius` have a point between them that is within half the
   radius (rounded up) of both, so a class goes to every leaf that its ball of half the radius reaches by the triangle bound:
   classes near a boundary go to both sides, and no pair is missed. The sample only shapes the shards; it never decides a link.
4. Each leaf's shard builds its own tree the same way down to small blocks, compares inside the blocks, and sends on a spanning
   set of links (at most one a point), never all pairs of a group.
5. Components of the links come from DataFrame steps; every document takes its component's smallest id.

Defined results: null and empty texts have fingerprint zero and link like any other; fewer words than a shingle make one shingle;
a null id is ignored for component_id, which is null only where a whole component has no id; repeated rows each get their row;
very long texts are read whole; empty tables give empty results; other columns are not read by `near_copies`, and kept by
`drop_near_copies`, which keeps one document of each component: the smallest id, or one without id where no row has any.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import stored, table, unused
from corvane.llm.components import labels

#: Classes on which the routing tree is shaped at most (16 for each shard), classes aimed at in a shard, and points compared with each other in a block.
SAMPLE, SHARD, PACK = 1 << 20, 1024, 128
HASH_SEED = 42
SENT = 1 << 20  # ids that are broadcast at most
U64 = np.uint64


def fingerprint(text: str | None, shingle: int = 3) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(line, HASH_SEED)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])
        n = len(words) - shingle + 1
        hashes = b"".join([digest(line[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    return majority(hashes)


def majority(hashes: bytes) -> int:
    """The fingerprint of big-endian 64-bit hashes: a bit is 1 if it is set in over half of them."""
    n, total = len(hashes) // 8, np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(np.frombuffer(hashes[8 * at : 8 * (at + (1 << 16))], np.uint8)).reshape(-1, 64)
        total += bits.sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


class Node:
    """A vantage point and a bound on the distance to it, with the subtrees inside and outside; or a leaf."""

    def __init__(self) -> None:
        self.leaf = 0
        self.point: np.uint64 | None = None
        self.bound = 0
        self.inside: Node | None = None
        self.outside: Node | None = None


def split(points: np.ndarray, margin: int) -> tuple[np.uint64, int] | None:
    """The vantage point and bound that leave the smaller larger side, boundary included; None if none divides the points well."""
    best = None
    for place in np.unique(np.linspace(0, len(points) - 1, 12).astype(int)):
        count = np.bincount(distance(points, points[place]), minlength=66)
        upto = np.cumsum(count)
        for bound in range(65):
            inner, outer = upto[min(bound + margin, 65)], len(points) - (upto[bound - margin] if bound >= margin else 0)
            if best is None or max(inner, outer) < best[0]:
                best = (max(inner, outer), points[place], bound)
    return best[1:] if best[0] <= 0.9 * len(points) else None


def sides(points: np.ndarray, node: Node, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points' balls of radius margin reach inside (d <= bound) and outside (d > bound)."""
    d = distance(points, node.point)
    return d - margin <= node.bound, d + margin > node.bound


def grow(points: np.ndarray, leaves: int, margin: int) -> tuple[Node, int]:
    """A routing tree over a sample with about so many leaves, and their number."""
    root, n = Node(), 0
    work = [(root, points, leaves)]
    while work:
        node, own, want = work.pop()
        cut = split(own, margin) if want > 1 and len(own) >= 8 else None
        if cut is None:
            node.leaf, n = n, n + 1
            continue
        node.point, node.bound = cut
        d = distance(own, node.point)
        node.inside, node.outside = Node(), Node()
        work += [(node.inside, own[d <= node.bound], want // 2), (node.outside, own[d > node.bound], want - want // 2)]
    return root, n


def route(points: np.ndarray, root: Node, margin: int) -> tuple[np.ndarray, np.ndarray]:
    """(leaf, place of the point) for every leaf that a point's ball reaches."""
    out, work = [], [(root, np.arange(len(points)))]
    while work:
        node, at = work.pop()
        if node.point is None:
            out.append((np.full(len(at), node.leaf), at))
            continue
        near, far = sides(points[at], node, margin)
        work += [(node.inside, at[near]), (node.outside, at[far])]
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest place of each place's component, for links a-b among n places."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        label = label[label]
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    return label


def links(points: np.ndarray, radius: int) -> np.ndarray:
    """The smallest place of each point's component under links within `radius`, all found by a local tree of overlapping blocks."""
    margin, label = (radius + 1) // 2, np.arange(len(points))
    found_a, found_b, work = [], [], [np.arange(len(points))]
    while work:
        at = work.pop()
        cut = split(points[at], margin) if len(at) > PACK else None
        if cut is not None:
            node = Node()
            node.point, node.bound = cut
            near, far = sides(points[at], node, margin)
            work += [at[near], at[far]]
            continue
        own = points[at]
        for start in range(0, len(at), PACK):
            i, j = np.nonzero(distance(own[start : start + PACK, None], own[None, start:]) <= radius)
            more = i < j
            i, j = i[more] + start, j[more] + start
            if len(i):
                local = spanning(len(at), i, j)
                moved = np.nonzero(local != np.arange(len(at)))[0]
                found_a.append(at[local[moved]])
                found_b.append(at[moved])
    return spanning(len(points), np.concatenate(found_a), np.concatenate(found_b)) if found_a else label


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """A stored table of (id, fp), fp as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t, shingle) for t in batch.column(1).to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    return stored(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long"), "fingerprints")


def tree_links(distinct: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b) fingerprints that join up all that lie within `radius` of each other, found by vantage-point trees. distinct: a stored table of distinct fp."""
    margin, n = (radius + 1) // 2, distinct.count()
    leaves = max(1, min(n // SHARD, SAMPLE // 16))
    sample = distinct.orderBy(F.xxhash64("fp"), "fp").limit(max(4096, 16 * leaves)).select("fp").toArrow()["fp"].to_numpy()
    sent = distinct.sparkSession.sparkContext.broadcast(grow(sample.astype(np.int64).view(U64), leaves, margin)[0])  # at most SAMPLE / 16 leaves

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            leaf, at = route(points.view(U64), sent.value, margin)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int32)), pa.array(points[at])], ["leaf", "fp"])

    def within(shard: pd.DataFrame) -> pd.DataFrame:
        points = np.unique(shard["fp"].to_numpy(np.int64))
        label = links(points.view(U64), radius)
        moved = label != np.arange(len(points))
        return pd.DataFrame({"a": points[moved], "b": points[label[moved]]})

    return distinct.select("fp").mapInArrow(deal, "leaf int, fp long").groupBy("leaf").applyInPandas(within, "a long, b long")


def classes(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(fp, label, component_id) of every distinct fingerprint of (id, fp) rows."""
    texts = fps.count()
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes", texts)
    node_label = labels(tree_links(distinct, radius), texts)
    linked = distinct.join(node_label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    linked = stored(linked, "simhash-linked", texts)
    least = linked.groupBy("label").agg(F.min("rep").alias("component_id"))
    return linked.join(least, "label").select("fp", "label", "component_id")


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: id, fp (signed long), label (a fingerprint that names the component), component_id."""
    fps = fingerprints(docs, id_col, text_col, shingle)
    return fps.join(classes(fps, radius).hint("shuffle_hash"), "fp").select(F.col("id").alias(id_col), "fp", "label", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """docs, all columns, with one document of each component."""
    fps = fingerprints(docs, id_col, text_col, shingle)
    mark = F.pandas_udf(lambda texts: pd.Series(np.array([fingerprint(t, shingle) for t in texts], U64).view(np.int64)), "long")
    return kept_of(docs, fps, stored(classes(fps, radius), "simhash-components"), mark, id_col, text_col)


def kept_of(docs: DataFrame, fps: DataFrame, known: DataFrame, mark: Callable[[Column], Column], id_col: str, text_col: str) -> DataFrame:
    """docs with one document of each component, given (id, fp) rows, every fp's (label, component_id), and how a text is marked with its fp."""
    texts = fps.count()
    judged = stored(fps.join(known.hint("shuffle_hash"), "fp").select("id", "label", "component_id"), "simhash-kept", texts)
    times, own_fp, own_label, own_id = (unused(docs, x) for x in ("corvane_n", "corvane_fp", "corvane_label", "corvane_id"))
    odd = stored(judged.where("id IS NOT NULL").groupBy("id").agg(F.count_if(F.col("id") == F.col("component_id")).alias("times")).where("times <> 1"), "simhash-odd", texts)
    more = not odd.where("times > 1").isEmpty()
    if not more and odd.count() <= SENT:  # the texts stay where they lie
        out = docs.where(docs[id_col].isNotNull()).join(odd.select(F.col("id").alias(own_id)).hint("broadcast"), docs[id_col] == F.col(own_id), "left_anti")
    else:
        keep = judged.where("id = component_id").groupBy("id").agg(F.count(F.lit(1)).alias("times"))
        rows = docs.join(keep.hint("shuffle_hash"), docs[id_col] == keep["id"]).select(*[docs[c] for c in docs.columns], keep["times"].alias(times))
        out = rows.drop(times)
        if more:  # repeated rows of one id
            out = rows.where(F.col(times) == 1).unionByName(rows.where(F.col(times) > 1).dropDuplicates([id_col])).drop(times)
    if judged.where("component_id IS NULL").isEmpty():
        return out
    # components without any id keep the first of their texts
    bare = known.where("component_id IS NULL").select(F.col("fp").alias(own_fp), F.col("label").alias(own_label))
    own = docs.where(docs[id_col].isNull()).withColumn(own_fp, mark(docs[text_col].cast("string")))
    return out.unionByName(own.join(bare, own_fp).dropDuplicates([own_label]).drop(own_fp, own_label))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_copies(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
