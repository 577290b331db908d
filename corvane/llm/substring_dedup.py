"""Removal of repeated passages with suffix automata of reference shards.

A passage of at least `window` words of a document goes if it also stands in a document with a smaller id.

1. Anchors. Every text is hashed word by word; each window's smallest k-gram hash (its minimizer) is an anchor. Equal windows
   have equal anchors, so only windows whose anchor occurs in several documents can repeat.
2. Windows. For those, the hash of the whole window; its owner is the smallest id that has it. Hashes only nominate.
3. Reference shards. The windows that a document owns and others share are its reference passages: each repeated passage once,
   cut into pieces (overlapping by a window less one word), dealt by owner into shards.
4. Automata. In a task, the shard's passages are built into one generalised suffix automaton, owners in ascending order, so a
   state's first document is the smallest one that holds its strings. Documents' nominated spans stream through it: matching
   statistics, held at `window`, give for each word whether the window that ends there stands in a smaller document. The
   comparison is of words, not hashes, so a hash collision can't remove anything.
5. Removed windows are united into maximal spans and cut out.

Sending a shard to all documents would compare everything with everything; here a shard goes to the tasks whose spans need it,
to several where spans are many (salted by their number of words), so a passage that a third of all documents share is spread.
Minima aggregate before their shuffle; windows meet owners in an equi-join whose hot keys adaptive execution may split.

Defined results: null and empty texts have no words and lose none; texts shorter than a window lose none; repeats inside one
document are no ground for removal; rows without an id neither lose words nor own any; repeated rows of one id are one document
(its first row in text order is the reference) and each keeps its own row; very long texts are handled whole; empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import freed, stored, table

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
#: Words of an anchor; reference words aimed at in a shard; words of a reference piece; span words aimed at in a task.
GRAM, SHARD_WORDS, PIECE_WORDS, TASK_WORDS = 16, 60_000, 60_000, 400_000
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def _powers(n: int, base: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64, by doubling."""
    out = np.ones(1, U64)
    while len(out) < n:
        step = U64(pow(base, len(out), 1 << 64))
        out = np.concatenate([out, out * step])
    return out[:n]


class WordHasher:
    """64-bit hashes of the words of a text, all at once: differences of a polynomial's running sum, scrambled."""

    def __init__(self) -> None:
        self.up = _powers(1 << 16, BASE)
        self.down = _powers(1 << 16, pow(BASE, -1, 1 << 64))

    def hashes(self, text: bytes) -> np.ndarray:
        b = np.frombuffer(text, np.uint8)
        blank = np.concatenate([[True], BLANK[b], [True]])
        edge = np.flatnonzero(blank[1:] != blank[:-1])
        starts, ends = edge[::2], edge[1::2]
        if not len(starts):
            return np.zeros(0, U64)
        n = len(b) + 1
        if len(self.up) < n:
            self.up, self.down = _powers(2 * n, BASE), _powers(2 * n, pow(BASE, -1, 1 << 64))
        run = np.concatenate([np.zeros(1, U64), np.cumsum((b.astype(U64) + U64(1)) * self.up[: len(b)], dtype=U64)])
        h = (run[ends] - run[starts]) * self.down[starts]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        h ^= h >> U64(29)
        return h * U64(BASE)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n words, by doubling."""
    power, width, runs = U64(BASE), 1, {1: words}
    pw = {1: power}
    with np.errstate(over="ignore"):
        while 2 * width <= n:
            a = runs[width]
            runs[2 * width] = a[: len(a) - width] * pw[width] + a[width:]
            pw[2 * width] = pw[width] * pw[width]
            width *= 2
        out, at, left = None, 0, n
        count = len(words) - n + 1
        while left:
            w = 1 << (left.bit_length() - 1)
            part = runs[w][at : at + count]
            out = part if out is None else out * pw[w] + part
            at, left = at + w, left - w
        out = out ^ (out >> U64(31))
        out = out * U64(0x94D049BB133111EB)
        return out ^ (out >> U64(30))


def minimizers(grams: np.ndarray, width: int) -> np.ndarray:
    """The smallest of every `width` consecutive gram hashes."""
    low, w = grams, 1
    while 2 * w <= width:
        low = np.minimum(low[: len(low) - w], low[w:])
        w *= 2
    n = len(grams) - width + 1
    return np.minimum(low[:n], low[width - w : width - w + n])


class Automaton:
    """A generalised suffix automaton over words; first[state] is the smallest document that holds the state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.len, self.first = [-1], [0], [-1]

    def add(self, words: list[str], doc: int) -> None:
        """Passages come in ascending order of doc."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        last = 0
        for w in words:
            q = nxt[last].get(w)
            if q is not None:  # already known, as in a passage that came before
                if length[q] == length[last] + 1:
                    last = q
                    continue
                last = self._clone(last, q, w)
                continue
            cur = len(nxt)
            nxt.append({})
            link.append(0)
            length.append(length[last] + 1)
            first.append(doc)
            p = last
            while p != -1 and w not in nxt[p]:
                nxt[p][w] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][w]
                link[cur] = q if length[q] == length[p] + 1 else self._clone(p, q, w)
            last = cur

    def _clone(self, p: int, q: int, w: str) -> int:
        nxt, link, length, first = self.next, self.link, self.len, self.first
        c = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        first.append(first[q])
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def repeats(self, words: list[str], window: int, doc: int) -> list[int]:
        """Starts of the windows of words that stand in a document before doc."""
        nxt, link, length, first = self.next, self.link, self.len, self.first
        v = n = 0
        out = []
        for i, w in enumerate(words):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
                if n >= window:
                    n = window
                    while length[link[v]] >= window:
                        v = link[v]
                    if first[v] < doc:
                        out.append(i - window + 1)
        return out


def runs_of(places: np.ndarray) -> list[tuple[int, int]]:
    """[first, last] of every run of consecutive numbers in a sorted array."""
    if not len(places):
        return []
    cut = np.flatnonzero(np.diff(places) != 1)
    return list(zip(places[np.concatenate([[0], cut + 1])].tolist(), places[np.concatenate([cut, [len(places) - 1]])].tolist(), strict=True))


def _anchors(docs: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Stored: (row, id, n_words, kept_sha256 of the whole text) and (id, anchors) of texts of a window or more."""
    kind, gram = docs.schema[id_col].dataType.simpleString(), min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            counts, shas, anchors = [], [], []
            for text in batch.column(1).to_pylist():
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                counts.append(len(words))
                shas.append(hashlib.sha256(b" ".join(words)).hexdigest())
                if len(words) >= window:
                    got = minimizers(gram_hashes(hasher.hashes(raw), gram), window - gram + 1)
                    anchors.append(np.unique(got).view(np.int64))
                else:
                    anchors.append(np.zeros(0, np.int64))
            flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(a) for a in anchors])]).astype(np.int32)), pa.array(np.concatenate(anchors) if anchors else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(shas, pa.string()), flat], ["id", "n_words", "whole_sha256", "anchors"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_words long, whole_sha256 string, anchors array<long>")
    seen = stored(rows, "repeat-anchors")
    return seen.select("id", "n_words", "whole_sha256"), seen.where(F.col("id").isNotNull() & (F.size("anchors") > 0)).select("id", "anchors")


def _windows(docs: DataFrame, id_col: str, text_col: str, window: int, shared: DataFrame) -> DataFrame:
    """Stored: (id, text, places, hashes) of the windows whose anchor several documents have. shared: id, anchors."""
    kind, gram = docs.schema[id_col].dataType.simpleString(), min(GRAM, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            places, hashes = [], []
            lists = batch.column(2)
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = hasher.hashes((text or "").encode("utf-8", "surrogatepass"))
                if len(words) < window:
                    places.append(np.zeros(0, np.int32))
                    hashes.append(np.zeros(0, np.int64))
                    continue
                low = minimizers(gram_hashes(words, gram), window - gram + 1)
                wanted = np.sort(lists[i].values.to_numpy().view(U64))
                spot = np.minimum(np.searchsorted(wanted, low), len(wanted) - 1)
                at = np.flatnonzero(wanted[spot] == low)
                places.append(at.astype(np.int32))
                hashes.append(gram_hashes(words, window)[at].view(np.int64))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(a) for a in places])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, t))) for x, t in ((places, np.int32), (hashes, np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *lists], ["id", "text", "places", "hashes"])

    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    return stored(texts.join(shared.hint("shuffle_hash"), "id").mapInArrow(run, f"id {kind}, text string, places array<int>, hashes array<long>"), "repeat-windows")


def _owned(windows: DataFrame) -> DataFrame:
    """Stored: (id, runs) with runs an array of (owner, first place, last place) of shared windows, by place."""
    each = windows.select("id", F.explode(F.arrays_zip("places", "hashes")).alias("w")).select("id", F.col("w.places").alias("place"), F.col("w.hashes").alias("hash"))
    # stored, so that the two exchanges of all nominated windows don't hold disk space at once, and so that a hot window's side of the join can be split
    owners = stored(each.groupBy("hash").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last").select("hash", "owner"), "repeat-owners")
    freed(windows.sparkSession)
    found = each.join(owners.hint("shuffle_hash"), "hash").groupBy("id").agg(F.collect_list(F.struct("place", "owner")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.column(1):
                flat = row.values
                place, owner = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("place", "owner"))
                order = np.argsort(place, kind="stable")
                place, owner = place[order], owner[order]
                keep = np.concatenate([[True], place[1:] != place[:-1]])  # repeated rows of one id
                place, owner = place[keep], owner[keep]
                cut = np.flatnonzero((np.diff(place) != 1) | (owner[1:] != owner[:-1]))
                first, last = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(place) - 1]])
                out.append([{"owner": o, "a": a, "b": b} for o, a, b in zip(owner[first].tolist(), place[first].tolist(), place[last].tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.struct([("owner", pa.int64()), ("a", pa.int32()), ("b", pa.int32())])))], ["id", "runs"])

    return stored(found.mapInArrow(run, "id long, runs array<struct<owner: bigint, a: int, b: int>>"), "repeat-runs")


def _passages(windows: DataFrame, owned: DataFrame, window: int) -> DataFrame:
    """Stored: (owner, id, at, piece, words, n) of every run: a reference piece where id is the owner, else a span to judge from word `at`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words, piece = (text or "").encode("utf-8", "surrogatepass").split(), [0, 0]
                for r in runs:
                    a, b = r["a"], r["b"] + window
                    if r["owner"] != key:
                        rows.append((r["owner"], key, a, -1, b" ".join(words[a:b]), b - a))
                        continue
                    for start in range(a, b - window + 1, PIECE_WORDS):  # pieces share all but one word of a window
                        end = min(b, start + PIECE_WORDS + window - 1)
                        if piece[1] and piece[1] + end - start > PIECE_WORDS + window:
                            piece = [piece[0] + 1, 0]
                        piece[1] += end - start
                        rows.append((key, key, start, piece[0], b" ".join(words[start:end]), end - start))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["owner", "id", "at", "piece", "words", "n"])

    texts = windows.select("id", "text").join(owned.hint("shuffle_hash"), "id")
    return stored(texts.mapInArrow(run, "owner long, id long, at int, piece int, words binary, n int"), "repeat-passages")


def _judged(passages: DataFrame, window: int) -> DataFrame:
    """(id, starts of removed windows) from the automata of all shards."""
    total = passages.where("piece >= 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = int(max(1, total // SHARD_WORDS))
    shard = F.pmod(F.xxhash64("owner"), F.lit(shards)).cast("int").alias("shard")
    references = passages.where("piece >= 0").select(shard, "piece", "id", "at", "words")
    pieces = stored(passages.where("piece > 0").groupBy("owner").agg(F.max("piece").alias("pieces")), "repeat-pieces")  # owners that need several
    spans = passages.where("piece < 0")
    spans = spans.withColumn("pieces", F.lit(0)) if pieces.isEmpty() else spans.join(pieces, "owner", "left")
    spans = spans.select(shard, F.explode(F.sequence(F.lit(0), F.coalesce("pieces", F.lit(0)))).alias("piece"), "id", "at", "words", "n")
    parts = spans.groupBy("shard", "piece").agg(F.floor(F.sum("n") / F.lit(TASK_WORDS)).cast("int").alias("more"))
    salted_references = references.join(parts, ["shard", "piece"]).select("shard", "piece", F.explode(F.sequence(F.lit(0), F.col("more"))).alias("salt"), "id", "at", "words")
    salted_spans = spans.join(parts, ["shard", "piece"]).select("shard", "piece", F.pmod(F.xxhash64("id", "at"), F.col("more") + 1).cast("int").alias("salt"), F.col("id").alias("doc"), F.col("at").alias("start"), F.col("words").alias("span"))

    def judge(references: pd.DataFrame, spans: pd.DataFrame) -> pd.DataFrame:
        automaton = Automaton()
        ordered = references.sort_values(["id", "at"], kind="stable")
        for doc, words in zip(ordered["id"].tolist(), ordered["words"].tolist(), strict=True):
            automaton.add(words.split(), doc)
        ids, starts = [], []
        for doc, at, words in zip(spans["doc"].tolist(), spans["start"].tolist(), spans["span"].tolist(), strict=True):
            if got := automaton.repeats(words.split(), window, doc):
                ids.append(doc)
                starts.append([at + i for i in got])
        return pd.DataFrame({"id": pd.Series(ids, dtype="int64"), "starts": pd.Series(starts, dtype=object)})

    keys = ["shard", "piece", "salt"]
    return salted_references.groupBy(*keys).cogroup(salted_spans.groupBy(*keys)).applyInPandas(judge, "id long, starts array<int>")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256, removed (array of [first word, last word]), kept_text (null where nothing went). Ids are whole numbers."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    all_rows, anchors = _anchors(docs, "id", "text", window)
    each = anchors.select("id", F.explode("anchors").alias("anchor"))
    several = each.groupBy("anchor").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("anchor")
    shared = stored(each.join(several.hint("shuffle_hash"), "anchor", "left_semi").groupBy("id").agg(F.collect_set("anchor").alias("anchors")), "repeat-shared")
    freed(docs.sparkSession)
    windows = _windows(docs, "id", "text", window, shared)
    freed(docs.sparkSession)
    owned = _owned(windows)
    freed(docs.sparkSession)
    passages = _passages(windows, owned, window)
    freed(docs.sparkSession)
    starts = _judged(passages, window).groupBy("id").agg(F.flatten(F.collect_list("starts")).alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = (text or "").encode("utf-8", "surrogatepass").split()
                gone = np.zeros(len(words) + 1, np.int64)
                at = np.unique(np.array(places, np.int64))
                at = at[at + window <= len(words)]
                np.add.at(gone, at, 1)
                np.add.at(gone, at + window, -1)
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
                rows.append((int(gone.sum()), hashlib.sha256(kept).hexdigest(), [list(x) for x in runs_of(np.flatnonzero(gone))], kept.decode("utf-8", "surrogatepass")))
            kinds = (pa.int64(), pa.string(), pa.list_(pa.list_(pa.int32())), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], ["id", "n_removed", "cut_sha256", "removed", "kept_text"])

    changed = windows.select("id", "text").dropDuplicates(["id", "text"]).join(starts.hint("shuffle_hash"), "id").mapInArrow(cut, "id long, n_removed long, cut_sha256 string, removed array<array<int>>, kept_text string")
    out = all_rows.join(changed, "id", "left")
    return out.select(F.col("id").cast(kind).alias(id_col), "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("cut_sha256", "whole_sha256").alias("kept_sha256"), F.coalesce("removed", F.array().cast("array<array<int>>")).alias("removed"), "kept_text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
