"""Product codes of vectors: integer k-means by parts, as an RDD tree aggregation over columnar NumPy blocks.

Vectors become fixed-point integers once and are stored in the shared folder as blocks: the vectors of one length from one Arrow
batch, component by component (part, dimension, vector), in the narrowest integers that hold them. Every pass reads those blocks. In
a round a task adds up distances to a part's entries dimension by dimension, takes the nearest entry, and `np.add.at` collects
int64 sums and counts; `treeAggregate` adds the tasks' tensors in a reduction tree. What travels is the size of the codebooks,
whatever the number of vectors, and no vector is shuffled.

Defined results
* null vectors, and those with a null or non-finite component, give no row.
* each length has codebooks of its own. A length that `parts` does not divide gives rows whose code, error and digest are null; it has no
  codebooks. An empty vector has empty parts: all codes 0, error 0.
* fewer vectors than entries: as many entries as vectors. Ties of the starting ids go to the lexically smaller vector; null ids come last.
* repeated rows count each. A null label is a label of its own.
* components too large for exact 64-bit distances are worked with as Python integers; an error beyond a long is null.
* an empty table gives no rows; other columns, whatever their names, are not read. The number of different lengths is taken to be small.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm._common import light_batches, stored, table

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Bytes of a block of 64-bit components, at most; a longer vector is a block by itself.
BLOCK_BYTES = 2 << 20
#: Labels that may be broadcast.
FEW_LABELS = 10_000
#: length -> (part, entry, dimension)
Books = dict[int, np.ndarray]


def fixed_point(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), exactly, scale being a power of two: int64, or objects where a component needs more."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if not y.size or np.abs(y).max() < 2.0**62:
        return y.astype(np.int64)
    whole = [int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(x.ravel().tolist(), y.ravel().tolist())]
    return np.array(whole, object).reshape(x.shape)


def packed(x: np.ndarray) -> tuple[str, bytes]:
    if x.dtype == object:
        return "O", pickle.dumps(x)
    top = int(np.abs(x).max()) if x.size else 0
    kind = "h" if top < 1 << 15 else "i" if top < 1 << 31 else "q"
    return kind, np.ascontiguousarray(x, kind).tobytes()


def unpacked(kind: str, raw: bytes, length: int, n: int, parts: int, exact: bool) -> np.ndarray:
    """(part, dimension, vector), as int64, or as Python integers unless exact."""
    x = pickle.loads(raw) if kind == "O" else np.frombuffer(bytes(raw), kind)
    return x.reshape(parts, length // parts, n).astype(np.int64 if exact else object)


def blocks(rows: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """A stored table of blocks: length, n, kind, parts (bytes, a component after the other), ids, labels."""
    light_batches(rows.sparkSession)
    id_type, label_type = rows.schema[id_col].dataType, rows.schema[label_col].dataType
    vector = rows[vector_col]
    if rows.schema[vector_col].dataType.simpleString() != "array<float>":
        vector = vector.cast("array<double>")
    fields = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.list_(to_arrow_type(id_type)), pa.list_(to_arrow_type(label_type))]
    names = ["length", "n", "kind", "parts", "ids", "labels"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors, labels = batch.columns
            there = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
            lengths = vectors.value_lengths().drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.cumsum(lengths) - lengths
            flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null components become NaN
            for length in np.unique(lengths).tolist():
                of = np.flatnonzero(lengths == length)
                step = max(1, BLOCK_BYTES // (8 * max(1, length)))
                for k in range(0, len(of), step):
                    some = of[k : k + step]
                    x = flat[starts[some][:, None] + np.arange(length)]
                    good = np.isfinite(x).all(1)
                    if good.any():
                        kind, raw = packed(fixed_point(x[good], scale).T)
                        at = pa.array(there[some[good]])
                        cells = [[length], [int(good.sum())], [kind], [raw], [ids.take(at).to_pylist()], [labels.take(at).to_pylist()]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, fields)], names)

    schema = f"length int, n int, kind string, parts binary, ids array<{id_type.simpleString()}>, labels array<{label_type.simpleString()}>"
    return stored(rows.select(rows[id_col].alias("id"), vector.alias("vector"), rows[label_col].alias("label")).mapInArrow(run, schema), "vector-blocks")


def _merged(a: dict, b: dict, add) -> dict:
    for k, v in b.items():
        a[k] = add(a[k], v) if k in a else v
    return a


def start(of: RDD, parts: int, entries: int) -> tuple[Books, bool]:
    """The codebooks of the smallest ids, and whether 64-bit integers hold every distance and sum."""

    def least(rows) -> list:
        return heapq.nsmallest(entries, rows, key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, r[1]))

    def add(a: tuple, b: tuple) -> tuple:
        return least(a[0] + b[0]), max(a[1], b[1]), a[2] + b[2]

    def seen(acc: dict, row) -> dict:
        if row.length % parts:
            return acc
        x = unpacked(row.kind, row.parts, row.length, row.n, parts, row.kind != "O").reshape(row.length, row.n)
        order = heapq.nsmallest(entries, range(row.n), key=lambda i: (row.ids[i] is None, row.ids[i] if row.ids[i] is not None else 0, x[:, i].tolist()))
        peak = max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0
        return _merged(acc, {row.length: ([(row.ids[i], x[:, i].tolist()) for i in order], peak, row.n)}, add)

    found = of.treeAggregate({}, seen, lambda a, b: _merged(a, b, add))
    exact = all(max(length * (2 * peak) ** 2, peak * n) < 1 << 62 for length, (_, peak, n) in found.items())
    kind = np.int64 if exact else object
    return {length: np.array([v for _, v in rows], kind).reshape(len(rows), parts, length // parts).transpose(1, 0, 2) for length, (rows, _, _) in found.items()}, exact


def nearest(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x (part, dimension, vector) -> the nearest entry of each part, ties to the smaller, and its squared distance: (part, vector) each."""
    parts, width, n = x.shape
    codes, least = np.zeros((parts, n), np.int64), np.zeros((parts, n), x.dtype)
    for p in range(parts):
        far = np.zeros((books.shape[1], n), x.dtype)
        for j in range(width):
            gap = x[p, j] - books[p, :, j, None]
            far += gap * gap
        codes[p] = far.argmin(0)
        least[p] = far[codes[p], np.arange(n)]
    return codes, least


def refined(of: RDD, books: Books, parts: int, exact: bool) -> Books:
    """One round: every part joins its nearest entry, which moves to the floor of its parts' mean; an unused entry stays."""

    def add(a: tuple, b: tuple) -> tuple:
        a[0].__iadd__(b[0]), a[1].__iadd__(b[1])
        return a

    def gather(acc: dict, row) -> dict:
        if row.length not in books:
            return acc
        x, own = unpacked(row.kind, row.parts, row.length, row.n, parts, exact), books[row.length]
        if row.length not in acc:
            acc[row.length] = np.zeros(own.shape, own.dtype), np.zeros(own.shape[:2], np.int64)
        sums, counts = acc[row.length]
        codes, _ = nearest(x, own)
        for p in range(parts):
            np.add.at(counts[p], codes[p], 1)
            for j in range(own.shape[2]):
                np.add.at(sums[p, :, j], codes[p], x[p, j])
        return acc

    found = of.treeAggregate({}, gather, lambda a, b: _merged(a, b, add))
    return {length: np.where(counts[:, :, None] > 0, sums // np.maximum(counts, 1)[:, :, None], books[length]) for length, (sums, counts) in found.items()}


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, Books]:
    """One row per usable vector: id, code (two hex digits a part), error, label, codebooks_sha256; and the codebooks by length.

    entries may be 256 at most.
    """
    made = blocks(rows, id_col, vector_col, label_col, scale)
    of = made.select("length", "n", "kind", "parts").rdd
    books, exact = start(made.select("length", "n", "kind", "parts", "ids").rdd, parts, entries)
    for _ in range(rounds):
        books = refined(of, books, parts, exact)
    digests = {k: digest(b) for k, b in books.items()}
    id_type, label_type = rows.schema[id_col].dataType, rows.schema[label_col].dataType
    hex_digits = np.frombuffer(b"0123456789abcdef", np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                length, n, kind, raw = (batch.column(c)[i].as_py() for c in range(4))
                ids, labels = (batch.column(c)[i].values for c in (4, 5))
                code = error = pa.nulls(n)
                if length in books:
                    codes, least = nearest(unpacked(kind, raw, length, n, parts, exact), books[length])
                    pairs = np.stack([hex_digits[codes.T >> 4], hex_digits[codes.T & 15]], 2).reshape(n, 2 * parts)
                    code = [r.tobytes().decode() for r in pairs]
                    error = [e if e < 1 << 63 else None for e in least.sum(0).tolist()]
                cells = [ids, pa.array(code, pa.string()), pa.array(error, pa.int64()), labels, pa.array([digests.get(length)] * n, pa.string())]
                yield pa.RecordBatch.from_arrays(cells, ["id", "code", "error", "label", "codebooks_sha256"])

    out = made.mapInArrow(run, f"id {id_type.simpleString()}, code string, error bigint, label {label_type.simpleString()}, codebooks_sha256 string")
    return out.select(F.col("id").alias(id_col), "code", "error", F.col("label").alias(label_col), "codebooks_sha256"), books


def with_label_error(codes: DataFrame, label_col: str = "label") -> DataFrame:
    """codes plus label_error, the errors summed over equal labels. The sums are broadcast only if they are few."""
    codes = stored(codes, "vector-codes")
    sums = stored(codes.groupBy(codes[label_col].alias("of")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    side = F.broadcast(sums) if sums.count() <= FEW_LABELS else sums
    return codes.join(side, codes[label_col].eqNullSafe(side["of"])).drop("of")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, _ = compress(table(spark, sf_dir, "embeddings"))
    return with_label_error(codes).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _sql() -> str:
    """Rounds as common table expressions: b are codebooks, a assignments."""
    near = """a{k} AS MATERIALIZED (SELECT vec_id, part, entry, dist FROM (
  SELECT vec_id, part, entry, dist, row_number() OVER (PARTITION BY vec_id, part ORDER BY dist, entry) AS place FROM (
    SELECT vec_id, part, entry, sum((v - c) * (v - c))::BIGINT AS dist FROM x JOIN b{k} USING (part, pos) GROUP BY ALL)) WHERE place = 1)"""
    move = """b{n} AS MATERIALIZED (SELECT part, entry, pos, CASE WHEN s.c IS NULL THEN b{k}.c ELSE s.c END AS c FROM b{k} LEFT JOIN (
  SELECT part, entry, pos, ((sum(v) - ((sum(v) % count(*) + count(*)) % count(*))) / count(*))::BIGINT AS c FROM x JOIN a{k} USING (vec_id, part) GROUP BY ALL) s USING (part, entry, pos))"""
    parts = [near.format(k=0)]
    for k in range(ROUNDS):
        parts += [move.format(k=k, n=k + 1), near.format(k=k + 1)]
    rounds = ",\n".join(parts)
    return f"""
WITH v AS (SELECT vec_id, label, embedding, len(embedding) // {PARTS} AS width FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda e: e IS NOT NULL AND isfinite(e)))),
x AS MATERIALIZED (SELECT vec_id, (i - 1) // width AS part, (i - 1) % width AS pos, floor({SCALE} * embedding[i]::DOUBLE)::BIGINT AS v FROM (SELECT vec_id, width, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM v)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM v QUALIFY entry < {ENTRIES}),
b0 AS MATERIALIZED (SELECT part, entry, pos, v AS c FROM x JOIN f USING (vec_id)),
{rounds},
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS}),
r AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(dist)::BIGINT AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM r JOIN v USING (vec_id), h
"""


#: For vectors of one length and ids that do not repeat, as in these tables.
OP12_SQL = _sql()
