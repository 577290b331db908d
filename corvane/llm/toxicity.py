"""Toxicity of noisy text: a noisy-channel decoder restores disguised words, a sparse logistic model scores the restored text.

1. Language model. Character n-grams (up to three) of all words of all documents are counted where the documents lie; tasks send
   counts by hashed n-gram. The table has eight cells for each distinct one met, so it grows with the corpus, from `GRAMS` cells up
   to the bound `WIDEST`.
2. Channel. A token that looks disguised (digits or symbols among letters, letters repeated three times or more, letters set apart
   by blanks or marks) becomes a lattice: per character itself, the letters it may stand for, or nothing; per run of a letter one,
   two or all. Viterbi decoding over the last two letters finds the likeliest word under the language model. Letters set apart by
   blanks, and tokens of more than `LONG` characters, are also decoded with word boundaries, as they may hold several words.
3. Features: restored words and their beginnings. Candidates are those that tell the classes apart best on the training rows.
4. Model: logistic regression with an L1 penalty (accelerated proximal gradient), fitted on at most `TRAIN_ROWS` labelled rows,
   chosen by the hash of their id, none of them held out. Only the text is an input of a score.

Defined results: null and empty texts score as the model's intercept says; null labels teach nothing; with no labelled row, or one
class only, every text has the same score; a null id is not held out; repeated rows score alike; very long texts are scored
whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import math
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import light_batches, table

#: Least cells of the n-gram counts; labelled rows to fit on; features kept; tokens that a task remembers; texts taken out of Arrow at once.
GRAMS, TRAIN_ROWS, FEATURES, MEMO, SLICE = 1 << 17, 20_000, 12_000, 40_000, 256
#: Most cells; characters that are counted at once; texts whose features are held at once.
WIDEST, COUNTED, FEW = 1 << 20, 1 << 18, 32
PREFIXES = (3, 4, 5, 6)
#: Letters that a character may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
GAPS = ".-_*~'^·"
SWAP, DROP, SHRINK, KEEP = 2.0, 1.0, 0.7, 3.0  # costs in nats: another letter, nothing, a shorter run, a mark inside a word
EDGE = "\x02"
STRIP = ".,;:?\"'()[]{}<>!*_-~…«»“”„"
REPEAT = re.compile(r"(.)\1{2,}")
DISGUISED = re.compile(r"(?=.*[^\W\d_])(?:.*[0-9@$!|+€£(¡].*|.*[.\-_*~'^·].*)", re.DOTALL)
NAMED = re.compile(r"\S+@\S+\.\w+|\w+://|www\.|[\w-]+(?:\.[\w-]+)*\.[a-z]{2,6}/")  # addresses are no words
MIX = re.compile(r"[^\W\d_]")


#: Tokens beyond this have their runs and gap marks collapsed before they are read, and may hold several words.
LONG = 40
LONG_RUN, GAP_RUN = re.compile(r"(.)\1{3,}", re.DOTALL), re.compile(r"([.\-_*~'^·])[.\-_*~'^·]+")
CODE, CHANGE = re.compile(r"[a-z0-9+/=_-]+"), re.compile(r"[a-z](?=[0-9])|[0-9](?=[a-z])")
SCHEME, HOST = re.compile(r"\w+://|www\."), re.compile(r"[\w.-]+\.[a-z]{2,6}")
SPACED = re.compile(r"(?<!\S)(?:\S\s+){2,}\S(?!\S)")
GAPPED = re.compile(r"(\S)(\s*)")
#: Code points that are letters, below 2^16; those above count as letters.
LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
FACTORS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


def cell(gram: str, cells: int = GRAMS) -> int:
    """The cell of a gram of one to three characters, of a power of two of them: in a smaller table it is the remainder."""
    h = 0
    for c, f in zip(reversed(gram), FACTORS, strict=False):
        h ^= (ord(c) + 1) * f & 0xFFFFFFFF
    h = (h ^ h >> 15) * 0x27D4EB2F & 0xFFFFFFFF
    return (h ^ h >> 13) % cells


def count_grams(text: str, total: np.ndarray) -> None:
    """Adds the 1-, 2- and 3-grams of the text's words (runs of letters, with an edge at both ends) to total."""
    points = np.frombuffer((text.lower() + "  ").encode("utf-32-le", "surrogatepass"), np.uint32)
    c = np.where((points >= 1 << 16) | LETTER[np.minimum(points, 0xFFFF)], points, np.uint32(ord(EDGE)))
    b = np.concatenate([np.full(1, ord(EDGE), np.uint32), c[:-1]])
    a = np.concatenate([np.full(1, ord(EDGE), np.uint32), b[:-1]])
    a = np.where(b == ord(EDGE), np.uint32(ord(EDGE)), a)
    inside = (b != ord(EDGE)) | (c != ord(EDGE))
    h = (c[inside] + np.uint32(1)) * np.uint32(FACTORS[0])
    for more in (None, (b[inside] + np.uint32(1)) * np.uint32(FACTORS[1]), (a[inside] + np.uint32(1)) * np.uint32(FACTORS[2])):
        if more is not None:
            h = h ^ more
        g = (h ^ h >> np.uint32(15)) * np.uint32(0x27D4EB2F)
        np.add.at(total, (g ^ g >> np.uint32(13)) & np.uint32(len(total) - 1), 1)


class Memo:
    """What was found for the last tokens: at most twice `MEMO` of them, those met again lately among them."""

    def __init__(self) -> None:
        self.new: dict[str, tuple[str, ...]] = {}
        self.old: dict[str, tuple[str, ...]] = {}

    def get(self, token: str) -> tuple[str, ...] | None:
        got = self.new.get(token)
        if got is None and (got := self.old.get(token)) is not None:
            self.put(token, got)
        return got

    def put(self, token: str, found: tuple[str, ...]) -> tuple[str, ...]:
        if len(self.new) >= MEMO:
            self.old, self.new = self.new, {}
        self.new[token] = found
        return found


class CharModel:
    """Interpolated character trigrams."""

    def __init__(self, counts: np.ndarray) -> None:
        self.counts = counts
        self.memo: dict[str, float] = {}

    def cost(self, a: str, b: str, c: str) -> float:
        """-log P(c | ab)."""
        got = self.memo.get(a + b + c)
        if got is None:
            n = lambda gram: float(self.counts[cell(gram, len(self.counts))])
            one = (n(c) + 0.01) / (n(EDGE) * 6 + 10)
            two = (n(b + c) + 4 * one) / (max(n(b), n(b + c)) + 4)
            three = (n(a + b + c) + 4 * two) / (max(n(a + b), n(a + b + c)) + 4)
            got = -math.log(min(1.0, max(three, 1e-9)))
            if len(self.memo) > MEMO:
                self.memo.clear()
            self.memo[a + b + c] = got
        return got

    def decode(self, token: str, split: bool = False) -> str:
        """The likeliest word behind a token; with `split` the likeliest words, a blank between them."""
        best = {(EDGE, EDGE): (0.0, "")}
        done: list[str] = []
        for at, arcs in enumerate(lattice(token), 1):
            after: dict[tuple[str, str], tuple[float, str]] = {}
            for (a, b), (cost, said) in best.items():
                for c, extra in arcs:
                    key = (b, c) if c else (a, b)
                    now = cost + extra + (self.cost(a, b, c) if c else 0.0)
                    if key not in after or (now, said + c) < after[key]:
                        after[key] = (now, said + c)
                    if split and c:  # the word ends here
                        now += self.cost(b, c, EDGE)
                        if (EDGE, EDGE) not in after or (now, said + c + " ") < after[EDGE, EDGE]:
                            after[EDGE, EDGE] = (now, said + c + " ")
            best = after
            if at % 64 == 0:  # what all readings begin with is settled, which keeps long tokens linear
                same = os.path.commonprefix([said for _, said in best.values()])
                done.append(same)
                best = {k: (cost, said[len(same) :]) for k, (cost, said) in best.items()}
        end = lambda a, b: 0.0 if split and b == EDGE else self.cost(a, b, EDGE)
        return "".join(done) + min((cost + end(a, b), said) for (a, b), (cost, said) in best.items())[1]


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """The arcs of each character: what it may stand for, '' for nothing, and what that costs."""
    for run in re.finditer(r"(.)\1*", token, re.DOTALL):
        c, n = run[1], len(run[0])
        letters = [(c, 0.0 if c.isalpha() else KEEP), *((x, SWAP) for x in LEET.get(c, ""))]
        for i in range(n):
            if c in GAPS:
                yield [*letters, ("", DROP)]
            elif i and n >= 3:
                yield [*letters, ("", SHRINK)]
            else:
                yield letters


def letter_runs(low: str) -> bool:
    """Whether a letter stands three times in a row."""
    p = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.flatnonzero((p[2:] == p[1:-1]) & (p[1:-1] == p[:-2]))
    return bool(len(at)) and bool(((p[at] >= 1 << 16) | LETTER[np.minimum(p[at], 0xFFFF)]).any())


def is_code(bare: str) -> bool:
    """Hexadecimal and base64 by their form: letters and digits mixed throughout, and digits that stand for no letter."""
    return ("2" in bare or "6" in bare) and CODE.fullmatch(bare) is not None and len(CHANGE.findall(bare)) >= 8


def is_address(token: str) -> bool:
    """NAMED for tokens of any length, in linear time."""
    name, at, host = token.partition("@")
    return bool(SCHEME.match(token) or HOST.fullmatch(token.partition("/")[0]) and "/" in token or at and name and "@" not in host and "." in host.strip("."))


class Restorer:
    """Text -> its words with disguises undone."""

    def __init__(self, counts: np.ndarray) -> None:
        self.model = CharModel(counts)
        self.memo = Memo()

    def readings(self, token: str) -> tuple[str, ...]:
        """A lower-case token's word, restored, without outer marks; of a long one the words that it may hold. Remembered."""
        got = self.memo.get(token)
        if got is None:
            got = self.memo.put(token, self.restored(token))
        return got

    def restored(self, token: str) -> tuple[str, ...]:
        bare = token.strip(STRIP)
        if not (REPEAT.search(bare) if bare.isalpha() else DISGUISED.match(bare) or REPEAT.search(bare)):
            return (bare,)  # plain words
        if not MIX.search(bare):
            return (bare,)  # nor are plain numbers words
        if len(bare) > LONG:
            short = GAP_RUN.sub(r"\1", LONG_RUN.sub(r"\1\1\1", bare))
            return (bare,) if is_address(token) or is_code(short) else self.both(short)
        if NAMED.match(token):
            return (bare,)
        inner = token.strip(".,;:?\"'()[]{}<>…«»“”„")
        return (self.model.decode(inner if inner and not inner.endswith("!") else bare).strip(STRIP),)

    def both(self, letters: str) -> tuple[str, ...]:
        """Letters read as one word, and the words of their likeliest division."""
        found = dict.fromkeys([self.model.decode(letters).strip(STRIP), *(w.strip(STRIP) for w in self.model.decode(letters, split=True).split())])
        return tuple(found)

    def spaced(self, low: str) -> list[str]:
        """Words whose letters are set apart by blanks, in a lower-case text.

        A run of letters is read whole, and in parts where its gaps are wider than its narrowest; each as one word and divided.
        """
        out: list[str] = []
        for m in SPACED.finditer(low):
            parts = GAPPED.findall(m[0])
            run: list[tuple[str, int]] = []
            for t, gap in [*parts, ("", "")]:
                if t and (t.isalpha() or t in LEET):
                    run.append((t, len(gap)))
                    continue
                if len(run) >= 3:
                    least = min(g for _, g in run[:-1])
                    cut = "".join(t + ("\n" if g > least and k < len(run) - 1 else "") for k, (t, g) in enumerate(run))
                    for one in dict.fromkeys([cut.replace("\n", ""), *cut.split("\n")]):
                        if len(one) >= 2:
                            out += self.both(LONG_RUN.sub(r"\1\1\1", one))
                run = []
        return out

    def parted(self, low: str) -> tuple[list[str], list[str]]:
        """The distinct tokens of a lower-case text: plain words without outer marks, and tokens that may be disguised."""
        plain, odd = [], []
        runs = letter_runs(low)
        for t in set(low.split()):
            bare = t if t.isalpha() else t.strip(STRIP)
            if bare.isalpha() and not (runs and REPEAT.search(bare)):
                plain.append(bare)
            else:
                odd.append(t)
        return plain, odd

    def words(self, text: str) -> set[str]:
        low = text.lower()
        plain, odd = self.parted(low)
        found = {*plain, *(w for t in odd for w in self.readings(t))}
        found.update(self.spaced(low))
        found.discard("")
        return found


def features(word: str) -> list[str]:
    return [word, *(word[:n] + "+" for n in PREFIXES if len(word) > n)]


def _descend(flat: np.ndarray, of: np.ndarray, y: np.ndarray, scale: np.ndarray, l1: float, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient for logistic regression over scaled 0/1 columns, with restarts."""
    m, n = len(y), len(scale)
    times = lambda v: np.bincount(of, (v * scale)[flat], minlength=m)
    back = lambda r: np.bincount(flat, r[of], minlength=n) * scale / m
    v = np.ones(n) / math.sqrt(max(1, n))
    size = 1.0
    for _ in range(12):  # the largest curvature, by power iteration
        v = back(times(v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    rate = 1.0 / (0.25 * size * 1.1 + 0.25 + l2)
    b = math.log((y.sum() + 0.5) / (m - y.sum() + 0.5))
    w = np.zeros(n)
    vw, vb, t = w, b, 1.0
    for _ in range(steps):
        r = 1 / (1 + np.exp(-np.clip(times(vw) + vb, -30, 30))) - y
        raw = vw - rate * (back(r) + l2 * vw)
        new = np.sign(raw) * np.maximum(0, np.abs(raw) - rate * l1)
        nb = vb - rate * r.mean()
        turn = float(((vw - new) * (new - w)).sum()) > 0
        t2 = 1.0 if turn else (1 + math.sqrt(1 + 4 * t * t)) / 2
        k = 0.0 if turn else (t - 1) / t2
        vw, vb, w, b, t = new + k * (new - w), nb + k * (nb - b), new, nb, t2
    return w * scale, float(b)


def fit(rows: list[np.ndarray], y: np.ndarray, n: int, steps: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression over sets of features (indices below n): an L1 fit at the universal noise level chooses the features, a ridge fit weighs them."""
    m = len(rows)
    flat, of = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(m), [len(r) for r in rows])
    scale = 1 / np.sqrt((np.bincount(flat, minlength=n) + 1) / m)
    rate = y.mean()
    l1 = 0.5 * math.sqrt(rate * (1 - rate) * 2 * math.log(max(2, n)) / m)
    chosen = np.flatnonzero(_descend(flat, of, y, scale, l1, 0.0, steps)[0])
    inside = np.full(n, -1)
    inside[chosen] = np.arange(len(chosen))
    keep = inside[flat] >= 0
    w = np.zeros(n)
    own, b = _descend(inside[flat[keep]], of[keep], y, scale[chosen], 0.0, 0.02 * l1, steps)
    w[chosen] = own
    return w, b


class Scorer:
    """A fitted model: restored words -> a score from 0 to 1."""

    def __init__(self, counts: np.ndarray, weights: dict[str, float], intercept: float) -> None:
        self.counts, self.weights, self.intercept = counts, weights, intercept

    def reader(self) -> Callable[[list[str | None]], list[float]]:
        """A function from texts to scores; what it remembers of tokens lasts from call to call."""
        restorer, weigh = Restorer(self.counts), self.weights
        starts = {f.rstrip("+")[:3] for f in weigh}  # words that begin otherwise bear no weight
        memo = Memo()

        def weighed(word: str) -> tuple[str, ...]:
            return tuple(f for f in features(word) if f in weigh) if word[:3] in starts else ()

        def told(text: str | None) -> float:
            low = (text or "").lower()
            plain, odd = restorer.parted(low)
            found = {f for w in plain if w[:3] in starts for f in weighed(w)}
            for t in odd:
                own = memo.get(t)
                if own is None:
                    own = memo.put(t, tuple(f for w in restorer.restored(t) for f in weighed(w)))
                if own:
                    found.update(own)
            for w in restorer.spaced(low):
                found.update(weighed(w))
            z = self.intercept + sum(sorted(weigh[f] for f in found))
            return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

        return lambda texts: list(map(told, texts))


def slices(column: pa.Array) -> Iterator[list[str | None]]:
    """A column's texts, a few at a time: no batch is ever held in Python as a whole."""
    for start in range(0, len(column), SLICE):
        yield column.slice(start, SLICE).to_pylist()


def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(start, FEW) for b in batches for start in range(0, b.num_rows, FEW))


def featured(batches: Iterator[pa.RecordBatch], restorer: Restorer) -> Iterator[pa.RecordBatch]:
    """(label, text) batches -> (label, f), `FEW` rows a batch: the features of a text take many times its own size."""
    for batch in few(batches):
        found = [sorted({f for w in restorer.words(t or "") for f in features(w)}) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["label", "f"])


def language_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """Hashed n-gram counts of all words of all texts."""
    light_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, waiting, size = np.zeros(WIDEST, np.int64), [], 0
        for text in (t for batch in batches for texts in slices(batch.column(0)) for t in texts):
            if text:
                waiting.append(text)
                size += len(text)
            if size > COUNTED:
                count_grams(" ".join(waiting), total)
                waiting, size = [], 0
        count_grams(" ".join(waiting), total)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "n"])

    rows = docs.select(docs[text_col].cast("string").alias("text")).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = rows.toArrow()  # at most WIDEST rows
    counts = np.zeros(min(WIDEST, max(GRAMS, 1 << (8 * got.num_rows).bit_length())), np.int64)
    np.add.at(counts, got.column("cell").to_numpy() % len(counts), got.column("n").to_numpy())
    return counts


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = TRAIN_ROWS) -> Scorer:
    """Fits on the labelled rows for which `usable` (over labels) holds: all, or the `rows` first by hashed id."""
    counts = language_model(docs, text_col)
    known = labels.where(usable & labels[label_col].isNotNull() & labels[id_col].isNotNull())
    known = known.groupBy(F.col(id_col).alias("key")).agg(F.max(label_col).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from featured(batches, Restorer(counts))

    chosen = docs.select(docs[id_col].alias("key"), docs[text_col].cast("string").alias("text")).join(F.broadcast(known), "key").select("label", "text")  # at most `rows` ids
    seen = chosen.mapInArrow(run, "label int, f array<string>").persist()
    try:
        totals = {r["label"]: r["n"] for r in seen.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        toxic, clean = totals.get(1, 0), totals.get(0, 0)
        if not toxic or not clean:
            return Scorer(counts, {}, 60.0 if toxic else -60.0)
        each = seen.select("label", F.explode("f").alias("f")).groupBy("f").agg(F.sum("label").alias("t"), F.count(F.lit(1)).alias("n"))
        rate = toxic / (toxic + clean)
        gap = F.abs(F.col("t") - F.col("n") * F.lit(rate)) / F.sqrt(F.col("n") * F.lit(rate * (1 - rate)) + F.lit(1.0))
        best = [r["f"] for r in each.where("n >= 2").orderBy(F.desc(gap), "f").limit(FEATURES).select("f").collect()]
        place = {f: i for i, f in enumerate(best)}

        def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in few(batches):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(place[f] for f in fs if f in place) for fs in batch.column(1).to_pylist()], pa.list_(pa.int32()))], ["label", "at"])

        got = seen.mapInArrow(pick, "label int, at array<int>").toArrow()  # at most `rows` rows of at most FEATURES numbers
    finally:
        seen.unpersist()
    lists = got.column("at").combine_chunks()
    ends, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
    sample = sorted(zip(got.column("label").to_pylist(), (flat[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)), strict=True))  # the same order however the rows were dealt
    w, b = fit([np.frombuffer(x, np.int32) for _, x in sample], np.array([label for label, _ in sample], float), len(best))
    return Scorer(counts, {f: float(w[i]) for f, i in place.items() if w[i]}, b)


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """One row per input row: id, score (and what `keep` names)."""
    keep = keep or []
    light_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # at most WIDEST cells and FEATURES weights
    source = docs.select(docs[text_col].cast("string").alias("corvane_text"), docs[id_col].alias(id_col), *keep)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[1:]) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = sent.value.reader()
        for batch in batches:
            scores = [s for texts in slices(batch.column(0)) for s in read(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], [*batch.schema.names[1:], "score"])

    return source.mapInArrow(run, schema)


def reject(docs: DataFrame, scorer: Scorer, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score `threshold` or more. Only texts go to Python and only scores come back."""
    light_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # at most WIDEST cells and FEATURES weights

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        read = sent.value.reader()
        for column in columns:
            yield pa.array([s for texts in slices(column) for s in read(texts)], pa.float64())

    return docs.where(scored(docs[text_col].cast("string")) < threshold)


def not_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 4 != 2, F.lit(False))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scorer = train(docs, marks, not_held_out(marks["doc_id"]))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return score(docs, scorer).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
