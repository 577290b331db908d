"""Document quality by co-training two views.

The text view sees the content alone (shares of capitals, marks, repeats and the like, and hashed words), the metadata view the
page's metadata alone (its categories, hashed, and its numbers). Both are ridge logistic models. They start from the labelled
rows; in every round each view labels all unlabelled rows, and its most confident pseudo-labels, in the proportion of the classes,
join the *other* view's training set. In the end each view's logit is calibrated (Platt) on labelled rows set apart, a third
small model combines the calibrated logits, and every document is scored.

Fitting uses at most `LABELLED` labelled rows, chosen by the hash of their id, and all unlabelled rows: they stay where they lie, and
each round and Newton step is a pass over them that sends sums alone. All rows are scored.

Defined results: null and empty texts have the text view's zero vector; null metadata is a category of its own, a null number is
0; null labels teach nothing; without labels of both classes every row has the same score; repeated rows score alike; very long
texts are read whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm._common import stored, table
from corvane.llm.toxicity import not_held_out

#: Labelled rows to fit on; cells of hashed words and categories; rounds; the confidence that pseudo-labels need.
LABELLED, WORDS, CELLS, ROUNDS, SURE = 12_000, 256, 128, 5, 0.95
#: Newton steps of a round; bins of logits in which confident rows are counted; tasks of a pass over the unlabelled rows.
STEPS, BINS, TASKS = 2, 4096, 64
MEASURES = 14


def word_cell(word: str, cells: int = WORDS) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % cells


def text_vector(text: str | None, memo: dict[str, int]) -> np.ndarray:
    """MEASURES shares and WORDS hashed word weights."""
    x = np.zeros(MEASURES + WORDS, np.float32)
    words = (text or "").split()
    if not words:
        return x
    n, chars, counts = len(words), len(text), Counter(words)
    letters = sum(map(str.isalpha, words))
    uppers = sum(map(str.isupper, words))
    inside = sum(text.count(c) for c in ".,;:")
    x[:MEASURES] = (
        math.log1p(n) / 8,
        uppers / n,
        letters / n,
        sum(map(str.isdigit, words)) / n,
        len(counts) / n,
        counts.most_common(1)[0][1] / n,
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
        min(3.0, text.count("!") / n),
        min(3.0, (text.count("|") + text.count("#") + text.count("*") + text.count("$") + text.count("%") + text.count("&")) / n),
        min(3.0, inside / n),
        min(3.0, sum(map(len, words)) / n / 8),
        min(3.0, 20 * text.count("\n") / chars),
        min(3.0, sum(map(len, counts)) / max(1, sum(map(len, words)))),
        sum(map(str.istitle, words)) / n,
    )
    for w, k in counts.items():
        i = memo.get(w)
        if i is None:
            if len(memo) > 300_000:
                memo.clear()
            i = memo[w] = MEASURES + word_cell(w)
        x[i] += k
    x[MEASURES:] = np.sqrt(x[MEASURES:] / n)
    return x


def meta_vector(values: Sequence[object]) -> np.ndarray:
    """Hashed categories and their pairs; numbers by size and by bin."""
    x = np.zeros(CELLS, np.float32)
    told = []
    for i, v in enumerate(values):
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            v = 0.0 if v != v or abs(v) == float("inf") else float(v)
            x[i % 4] += math.copysign(math.log1p(abs(v)), v) / 10
            told.append(f"{i}:{int(math.log2(1 + abs(v)))}")
        else:
            told.append(f"{i}={v}")
    for t in [*told, *(a + "&" + b for k, a in enumerate(told) for b in told[k + 1 :])]:
        x[4 + zlib.crc32(t.encode("utf-8", "surrogatepass")) % (CELLS - 4)] = 1.0
    return x


def ridge(x: np.ndarray, y: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Logistic regression (last weight: intercept) by damped Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)
    penalty = np.full(x.shape[1], l2)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    w[-1] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate([x, np.ones((len(x), 1))], axis=1).astype(np.float64)


def moments(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted logistic loss at w."""
    x = _with_one(x)
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def bins(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(((logit(w, x.astype(np.float64)) + 30) / 60 * BINS).astype(np.int64), 0, BINS - 1)


def chosen(counts: np.ndarray, rate: float, share: float) -> tuple[np.ndarray, np.ndarray]:
    """How much each bin of logits counts as a positive and as a negative pseudo-label: a share of all confident rows, the most
    confident first, in the proportion of the classes; the bin at the border counts in part."""
    edge = (math.log(SURE / (1 - SURE)) + 30) / 60 * BINS
    sure = np.arange(BINS) >= math.ceil(edge)
    up, down = np.where(sure, counts, 0.0)[::-1], np.where(sure[::-1], counts, 0.0)
    n = share * min(up.sum() / rate, down.sum() / (1 - rate))
    take = lambda c, m: np.clip((m - (np.cumsum(c) - c)) / np.maximum(c, 1), 0.0, 1.0) * (c > 0)
    return take(up, n * rate)[::-1], take(down, n * (1 - rate))


class Pool:
    """Unlabelled rows in memory, as the pair of their views."""

    def __init__(self, views: tuple[np.ndarray, np.ndarray]) -> None:
        self.views = views

    def total(self, part: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> np.ndarray:
        """The sum of part over all rows."""
        return part(self.views)


class FarPool(Pool):
    """Unlabelled rows in a stored table of half-precision vectors; each sum is one pass over it where it lies."""

    def __init__(self, rows: DataFrame, sizes: tuple[int, int]) -> None:
        self.rows, self.sizes = rows, sizes

    def total(self, part: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]) -> np.ndarray:
        first, width = self.sizes[0], sum(self.sizes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = None
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    x = np.frombuffer(b"".join(batch.column(0).slice(start, 2048).to_pylist()), np.float16).reshape(-1, width).astype(np.float32)
                    own = part((x[:, :first], x[:, first:]))
                    whole = own if whole is None else whole + own
            if whole is not None:
                yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([whole.tobytes()], pa.binary())], ["task", "sums"])

        got = self.rows.coalesce(TASKS).mapInArrow(run, "task long, sums binary").collect()  # at most TASKS sums
        return np.sum([np.frombuffer(r["sums"]) for r in sorted(got, key=lambda r: r["task"])], axis=0) if got else np.zeros(1)


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: Pool | tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """The two views' weights after exchanging confident pseudo-labels.

    In every round one pass judges all unlabelled rows with both models; a growing share of the rows that a view is sure of, up to
    all that keep the proportion of the classes, teaches the other view by Newton steps, each a further pass.
    """
    pool = pool if isinstance(pool, Pool) else Pool(pool)
    rate, models = float(y.mean()), [ridge(x, y) for x in labelled]
    alone, ones = list(models), np.ones(len(y))
    for turn in range(1, rounds + 1):
        judges = list(models)
        counts = pool.total(lambda xs: np.concatenate([np.bincount(bins(w, x), minlength=BINS) for w, x in zip(judges, xs, strict=True)]).astype(np.float64))
        if not counts.any():
            return models
        marks = [chosen(c, rate, turn / rounds) for c in counts.reshape(2, BINS)]
        taught = [v for v in (0, 1) if marks[1 - v][0].any()]
        models = [models[v] if v in taught else alone[v] for v in (0, 1)]
        for _ in range(STEPS if turn < rounds else 3 * STEPS):
            now, open_ = list(models), list(taught)

            def part(xs: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
                out = []
                for v in open_:
                    at = bins(judges[1 - v], xs[1 - v])
                    up, down = marks[1 - v][0][at], marks[1 - v][1][at]
                    use = up + down > 0
                    g, h = moments(now[v], xs[v][use], (up > 0)[use].astype(float), (up + down)[use])
                    out += [g, h.ravel()]
                return np.concatenate(out)

            if not open_:
                break
            sums, place = pool.total(part), 0
            for v in open_:
                d = len(now[v])
                g, h = moments(now[v], labelled[v], y, ones)
                penalty = np.full(d, 1.0)
                penalty[-1] = 1e-6
                g += sums[place : place + d] + penalty * now[v]
                h += sums[place + d : place + d + d * d].reshape(d, d) + np.diag(penalty)
                place += d + d * d
                step = np.linalg.solve(h, g)
                step *= min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
                models[v] = now[v] - step
                if np.abs(step).max() < 1e-4:
                    taught.remove(v)
    return models


class QualityModel:
    """Both views, their calibration and the combination."""

    def __init__(self, views: list[np.ndarray], platt: list[np.ndarray], combined: np.ndarray, flat: float | None = None) -> None:
        self.views, self.platt, self.combined, self.flat = views, platt, combined, flat

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text view, metadata view, combined) probabilities."""
        if self.flat is not None:
            return tuple(np.full(len(text), self.flat) for _ in range(3))
        z = np.stack([logit(p, logit(w, x)[:, None]) for w, p, x in zip(self.views, self.platt, (text, meta), strict=True)], axis=1)
        return tuple(1 / (1 + np.exp(-a)) for a in (z[:, 0], z[:, 1], logit(self.combined, z)))


def fitted(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: Pool) -> QualityModel:
    """Every fourth labelled row (in hashed order) is set apart for calibration."""
    if len(y) < 8 or y.min() == y.max():
        return QualityModel([], [], np.zeros(0), float(y.mean()) if len(y) else 0.5)
    apart = np.arange(len(y)) % 4 == 3
    if y[apart].min() == y[apart].max() or y[~apart].min() == y[~apart].max():
        apart[:] = False
    own = ~apart
    held = apart if apart.any() else own
    views = co_train((text[own], meta[own]), y[own], pool)
    platt = [ridge(logit(w, x[held])[:, None], y[held], 0.01) for w, x in zip(views, (text, meta), strict=True)]
    z = np.stack([logit(p, logit(w, x[held])[:, None]) for w, p, x in zip(views, platt, (text, meta), strict=True)], axis=1)
    return QualityModel(views, platt, ridge(z, y[held], 0.1))


def _vectors(docs: DataFrame, text_col: str, meta_cols: Sequence[str], keep: list[Column]) -> tuple[DataFrame, int]:
    source = docs.select(docs[text_col].cast("string").alias("t"), *[_plain(docs, c).alias(f"m{i}") for i, c in enumerate(meta_cols)], *keep)
    return source, 1 + len(meta_cols)


def _plain(docs: DataFrame, name: str) -> Column:
    return docs[name].cast("double") if isinstance(docs.schema[name].dataType, T.NumericType) else docs[name].cast("string")


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", meta_cols: Sequence[str] = ("source", "lang", "n_chars")) -> QualityModel:
    known = labels.where(usable & labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.min(label_col).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(LABELLED)
    source, at = _vectors(docs, text_col, meta_cols, [docs[id_col].alias("key")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            texts, metas = _rows(batch, at, memo)
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("turn"), pa.array(list(texts.reshape(len(texts), -1)), pa.list_(pa.float32())), pa.array(list(metas), pa.list_(pa.float32()))], ["label", "turn", "text", "meta"])

    chosen = source.join(F.broadcast(known), "key").select(*source.columns[:-1], "label", F.xxhash64("key").alias("turn"))  # at most LABELLED ids
    got = chosen.mapInArrow(run, "label int, turn long, text array<float>, meta array<float>").toArrow()
    if not got.num_rows:
        return QualityModel([], [], np.zeros(0), 0.5)
    label, turn = got.column("label").to_numpy(), got.column("turn").to_numpy()
    text, meta = (got.column(c).combine_chunks().values.to_numpy().reshape(got.num_rows, -1) for c in ("text", "meta"))
    order = np.lexsort((*meta.T[:4], text[:, 0], turn))
    label, text, meta = label[order], text[order], meta[order]
    return fitted(text, meta, label.astype(float), FarPool(_pool(docs, labels, id_col, text_col, meta_cols), (text.shape[1], meta.shape[1])))


def _pool(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, meta_cols: Sequence[str]) -> DataFrame:
    """A stored table of the vectors of all unlabelled rows, both views end to end."""
    source, at = _vectors(docs, text_col, meta_cols, [docs[id_col].alias("key")])
    free = source.where("key IS NOT NULL").join(labels.select(labels[id_col].alias("key")).hint("merge"), "key", "left_anti").select(*source.columns[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                rows = np.clip(np.concatenate(_rows(batch.slice(start, 2048), at, memo), axis=1), -60000, 60000).astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary())], ["x"])

    return stored(free.mapInArrow(run, "x binary"), "quality-pool")


def _rows(batch: pa.RecordBatch, at: int, memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    texts = np.stack([text_vector(t, memo) for t in batch.column(0).to_pylist()]) if batch.num_rows else np.zeros((0, MEASURES + WORDS), np.float32)
    values = [batch.column(i).to_pylist() for i in range(1, at)]
    metas = np.stack([meta_vector([v[k] for v in values]) for k in range(batch.num_rows)]) if batch.num_rows else np.zeros((0, CELLS), np.float32)
    return texts, metas


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", meta_cols: Sequence[str] = ("source", "lang", "n_chars")) -> DataFrame:
    """One row per input row: id, text_score, meta_score, score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # a few hundred weights
    source, at = _vectors(docs, text_col, meta_cols, [docs[id_col].alias("key")])
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                yield pa.RecordBatch.from_arrays([part.column(at), *(pa.array(s, pa.float64()) for s in sent.value.scores(*_rows(part, at, memo)))], ["key", "text_score", "meta_score", "score"])

    return source.mapInArrow(run, f"key {kind}, text_score double, meta_score double, score double").withColumnRenamed("key", id_col)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = score(docs, train(docs, marks, not_held_out(marks["doc_id"])))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return rows.select("doc_id", held_out.alias("held_out"), "text_score", "meta_score", "score", (F.col("score") >= 0.5).cast("int").alias("kept"))
