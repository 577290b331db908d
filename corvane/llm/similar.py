"""SimHash near-duplicates whose links are verified: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. A text's shingles are hashed to 64 bits; equal sets are one class, and every class has a SimHash fingerprint: the majority of each
   bit over its shingles' hashes.
2. Classes with one fingerprint meet its smallest class, and the fingerprints meet in vantage-point trees (`simhash.tree_links`, `RADIUS`
   bits). These candidates are verified on whole sets, read again from the texts; their components are groups from here on.
3. At a similarity of 0.8 fingerprints differ in about 10 of 64 bits, with a wide spread, and a radius that holds them all sends nearly
   every class to nearly every leaf of a tree. So what the radius leaves out is found between the groups, exactly. Shingles have one global
   order: rare ones first, those that a sample of the corpus shows in several texts last. Two sets of similarity s share a shingle among
   the first n - ceil(s * n) + 1 of each, so pairs are looked for among these alone and none is missed. The sample (`SAMPLE` texts,
   `COMMON` shingles) only orders; it never decides a link.
4. A shared shingle at places i and j of two ordered sets leaves them 1 + min(n1 - i - 1, n2 - j - 1) shingles to share at most, and
   every class has a sketch of `BITS` parities: bit k tells whether an odd number of its shingles hash to k. The sketches of two sets
   differ in no more bits than their symmetric difference has shingles, and similar sets differ in (n1 + n2) / 9 at most. Pairs that
   either rules out are no candidates; no link is dropped by it. A sketch of so few bits says nothing on long texts, so pairs that are left
   are put to wide sketches, of as many bits as the set has shingles or more: what passes these too is nearly always similar, and whole
   sets move for it alone.
5. Each class first meets the `PIVOTS` smallest classes of each of its shared shingles that are in other groups. What then stands in other
   components than most of a shingle's classes meets all of them. Components come from DataFrame steps.

Defined results are those of `simhash.drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm._common import discarded, freed, light_batches, stored
from corvane.llm.components import labels
from corvane.llm.simhash import HASH_SEED, SENT, kept_of, majority, tree_links

SHINGLE, NUM, DEN = 5, 4, 5  # words; similarity NUM / DEN
SAMPLE, COMMON, PIVOTS = 8192, 65536, 8
BITS, RADIUS = 512, 2
#: Pairs of whole sets that a task compares at least.
HEAVY_ROWS = 256


def grams(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; fewer words than a shingle make one, no words none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    line, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= shingle:
        return np.frombuffer(digest(line, HASH_SEED), ">i8").astype(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - shingle + 1
    hashes = b"".join([digest(line[a:b], HASH_SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)])
    return np.unique(np.frombuffer(hashes, ">i8").astype(np.int64))


def key_of(own: np.ndarray) -> int:
    """One signed long for a set."""
    return int(np.array(xxhash.xxh64_intdigest(own.tobytes(), HASH_SEED), np.uint64).view(np.int64)) if len(own) else 0


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first shingles of a set in the global order, as many as a similar set must share one of."""
    n = len(own)
    if not n:
        return own
    weight = np.full(n, -1)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, rank[at], -1)
    return own[np.lexsort((own, weight))[: n - (NUM * n + DEN - 1) // DEN + 1]]


def _lists(xs: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, xs)]), pa.int32()), pa.array(np.concatenate([*xs, np.zeros(0, np.int64)])))


def common_grams(docs: DataFrame, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that several texts of a sample hold, sorted, and their places by frequency."""
    part = max(1, docs.count() // SAMPLE)
    text = docs[text_col].cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(grams(t))], ["s"])

    rows = docs.where(F.pmod(F.xxhash64(text), F.lit(part)) == 0).select(text.alias("text")).mapInArrow(run, "s long")
    got = rows.groupBy("s").count().where("count > 1").orderBy(F.desc("count"), "s").limit(COMMON).toArrow()
    s, n = got.column("s").to_numpy(), got.column("count").to_numpy()
    order = np.argsort(s)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, n))] = np.arange(len(s))
    return s[order].astype(np.int64), rank[order]


def sketch(own: np.ndarray, bits: int = BITS) -> np.ndarray:
    """bits parities of a set, as bytes."""
    return np.packbits(np.bincount(own.view(np.uint64) % np.uint64(bits), minlength=bits).astype(np.uint8) & 1)


def wide_sketch(own: np.ndarray) -> bytes:
    """As many parities as the set has shingles, up to the next power of two, BITS at least."""
    return sketch(own, max(BITS, 1 << (len(own) - 1).bit_length())).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """In how many bits two wide sketches differ: a longer one is folded to the other's length first."""
    long, short = (x, y) if len(x) >= len(y) else (y, x)
    while len(long) > len(short):
        half = len(long) // 2
        long = (int.from_bytes(long[:half], "big") ^ int.from_bytes(long[half:], "big")).to_bytes(half, "big")
    return (int.from_bytes(long, "big") ^ int.from_bytes(short, "big")).bit_count()


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stored table of (id, fp, sim, n, prefix, sketch, wide); fp names the set, sim is its SimHash fingerprint."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(common_grams(docs, text_col))  # at most COMMON shingles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = sent.value
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = [grams(t) for t in part.column(1).to_pylist()]
                sims = np.array([majority(g.astype(">i8").tobytes()) for g in own], np.uint64).view(np.int64)
                cols = [pa.array([key_of(g) for g in own], pa.int64()), pa.array(sims), pa.array(list(map(len, own)), pa.int64()), _lists([prefix(g, common, rank) for g in own]), _lists([sketch(g).view(np.int64) for g in own]), pa.array([wide_sketch(g) for g in own], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], ["id", "fp", "sim", "n", "prefix", "sketch", "wide"])

    return stored(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, fp long, sim long, n long, prefix array<long>, sketch array<long>, wide binary"), "shingle-sets")


def whole_sets(docs: DataFrame, need: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A stored table of (fp, grams), once for each class of `need` (fp, id)."""
    kind = docs.schema[id_col].dataType.simpleString()
    how = "broadcast" if need.count() <= SENT else "shuffle_hash"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = [grams(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([key_of(g) for g in own], pa.int64()), _lists(own)], ["id", "fp", "grams"])

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    asked = need.select(F.col("id").alias("id2")).distinct().hint(how)
    read = texts.join(asked, F.col("id").eqNullSafe(F.col("id2")), "left_semi").mapInArrow(run, f"id {kind}, fp long, grams array<long>").alias("r")
    own = need.alias("w").hint(how)
    out = stored(read.join(own, (F.col("r.fp") == F.col("w.fp")) & F.col("r.id").eqNullSafe(F.col("w.id")), "left_semi").select("fp", "grams"), "shingle-candidates")
    return out if out.count() == need.count() else stored(out.dropDuplicates(["fp"]), "shingle-candidates")  # repeated rows


def verified(pairs: DataFrame, sets: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The (a, b) pairs whose whole sets are similar, stored."""
    own = sets.groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("bits"), F.min("id").alias("id"))
    side = lambda x: own.select(F.col("fp").alias(x), F.col("n").alias("n" + x), F.col("bits").alias("bits" + x), F.col("id").alias("id" + x))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_close("bitsa", "bitsb", "na", "nb"))
    met = stored(near.select("a", "b", "na", "nb", "ida", "idb"), "shingle-met", max(pairs.count(), sets.count()))
    near = stored(_widely_close(met, sets), "shingle-near", met.count())
    links = near.count()
    need = stored(near.select("a", "ida").union(near.select("b", "idb")).toDF("fp", "id").distinct(), "shingle-asked", 2 * links)
    grams_of = read(need)
    both = near.select("a", "b").join(grams_of.select(F.col("fp").alias("a"), F.col("grams").alias("x")), "a").join(grams_of.select(F.col("fp").alias("b"), F.col("grams").alias("y")), "b")
    inter = F.size(F.array_intersect("x", "y"))
    out = stored(both.where(DEN * inter >= NUM * (F.size("x") + F.size("y") - inter)).select("a", "b"), "shingle-edges", links, HEAVY_ROWS)
    discarded(met, near, need, grams_of)
    return out


def _widely_close(met: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b, ida, idb) of (a, b, na, nb, ida, idb) whose wide sketches allow that the sets are similar."""
    asked = met.select(F.col("a").alias("fp")).union(met.select("b")).distinct()
    wide = sets.join(asked.hint("broadcast" if 2 * met.count() <= SENT else "shuffle_hash"), "fp", "left_semi").groupBy("fp").agg(F.first("wide").alias("wide"))
    side = lambda x: wide.select(F.col("fp").alias(x), F.col("wide").alias("wide" + x))
    names = ["a", "b", "ida", "idb"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb, xs, ys = (batch.column(i).to_pylist() for i in range(4))
            good = [(NUM + DEN) * apart(x, y) <= (DEN - NUM) * (n + m) for n, m, x, y in zip(na, nb, xs, ys, strict=True)]
            yield batch.select(names).filter(pa.array(good, pa.bool_()))

    rows = met.join(side("a"), "a").join(side("b"), "b").select("na", "nb", "widea", "wideb", *names)
    return rows.mapInArrow(run, met.select(*names).schema)


def simhash_pairs(sets: DataFrame) -> DataFrame:
    """A stored table of (a, b), a < b: classes of one fingerprint with its smallest class, and those that the vantage-point trees join up."""
    texts = sets.count()
    points = stored(sets.groupBy(F.col("sim").alias("fp")).agg(F.min("fp").alias("class")), "simhash-points", texts)
    near = tree_links(points, RADIUS).alias("l")
    ends = lambda x: points.select(F.col("fp").alias(x), F.col("class").alias("class" + x))
    far = near.join(ends("a"), "a").join(ends("b"), "b").select("classa", "classb")
    same = sets.join(points.select(F.col("fp").alias("sim"), "class"), "sim").select("fp", "class").where("fp <> class")
    return stored(far.union(same).toDF("x", "y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "simhash-pairs", 2 * texts)


def similar_pairs(sets: DataFrame, read: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A table of (a, b): links between similar classes that join all that belong together."""
    by_print = simhash_pairs(sets)
    edges = verified(by_print, sets, read)
    group = labels(edges, edges.count()).select(F.col("node").alias("fp"), F.col("label").alias("g"))
    grouped = sets.select("fp", "n", "prefix").join(group.hint("broadcast" if group.count() <= SENT else "shuffle_hash"), "fp", "left")
    rows = grouped.select("fp", "n", F.coalesce("g", "fp").alias("g"), F.posexplode("prefix").alias("i", "s"))
    ordered = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * (DEN - NUM) // DEN + sets.count()  # shingles in all prefixes
    freed(sets.sparkSession)
    own = Window.partitionBy("s")
    several = rows.withColumns({"low": F.min("g").over(own), "high": F.max("g").over(own)}).where("low < high")
    shared = stored(several.groupBy("s", "fp").agg(*[F.first(c).alias(c) for c in ("n", "i", "g")]), "shingle-shared", ordered)
    freed(sets.sparkSession)
    sketches = sets.groupBy("fp").agg(F.first("sketch").alias("bits"))
    rows, bare = shared.count(), shared
    shared = stored(bare.join(sketches, "fp"), "shingle-shared", max(rows, sets.count()))
    discarded(bare)
    freed(sets.sparkSession)
    pivot = shared.withColumn("k", F.row_number().over(Window.partitionBy("s").orderBy("fp"))).where(F.col("k") <= PIVOTS).drop("k")
    met = stored(_meeting(shared, pivot).distinct(), "shingle-pairs", PIVOTS * rows)
    edges = edges.union(verified(met, sets, read))
    crowded = shared.groupBy("s").count().where(F.col("count") > PIVOTS).select("s")
    now = shared.drop("g").join(crowded, "s").join(labels(edges, edges.count()).withColumnRenamed("node", "fp"), "fp", "left").withColumn("g", F.coalesce("label", "fp")).drop("label")
    most = now.groupBy("s", "g").count().groupBy("s").agg(F.max_by("g", F.struct("count", "g")).alias("most"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    now = stored(now.join(most, "s").drop("parts"), "shingle-apart", rows)
    rest = stored(_meeting(now, now.where("g <> most")).distinct().join(met, ["a", "b"], "left_anti"), "shingle-pairs", PIVOTS * rows)
    more = verified(rest, sets, read)
    discarded(by_print, shared, met, now, rest)
    return edges.union(more)


def _close(x: str, y: str, n: str, n2: str) -> Column:
    """Whether two sketches allow that sets of these sizes are similar."""
    apart = reduce(add, [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(BITS // 64)])
    return (NUM + DEN) * apart <= (DEN - NUM) * (F.col(n) + F.col(n2))


def _meeting(all_: DataFrame, some: DataFrame) -> DataFrame:
    """(a, b), a < b: the pairs of `all_` and `some` in two groups that share a shingle, at places and with sizes and sketches that allow the similarity."""
    other = some.select("s", *[F.col(c).alias(c + "2") for c in ("fp", "n", "i", "g", "bits")])
    left = F.least(F.col("n") - F.col("i"), F.col("n2") - F.col("i2"))  # the shared one and what may follow it
    fits = (F.col("g") != F.col("g2")) & ((NUM + DEN) * left >= NUM * (F.col("n") + F.col("n2")))
    pairs = all_.join(other, "s").where(fits & _close("bits", "bits2", "n", "n2"))
    return pairs.select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b"))


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, with one document of each component of similar texts."""
    light_batches(docs.sparkSession)
    sets = shingle_sets(docs, id_col, text_col)
    texts, edges = sets.count(), similar_pairs(sets, lambda need: whole_sets(docs, need, id_col, text_col))
    node_label = labels(edges, edges.count()).withColumnRenamed("node", "fp")
    linked = stored(sets.groupBy("fp").agg(F.min("id").alias("rep")).join(node_label, "fp", "left").withColumn("label", F.coalesce("label", "fp")), "shingle-linked", texts)
    known = stored(linked.join(linked.groupBy("label").agg(F.min("rep").alias("component_id")), "label").select("fp", "label", "component_id"), "shingle-components", texts)
    mark = F.pandas_udf(lambda texts: pd.Series([key_of(grams(t)) for t in texts], dtype="int64"), "long")
    out = kept_of(docs, sets.select("id", "fp"), known, mark, id_col, text_col)
    discarded(sets, linked)
    return out
