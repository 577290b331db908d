"""Secret scanning with corpus-wide ownership frequency.

A first pass finds candidates in every text: three base kinds (an assigned secret, an access key id, a long hexadecimal run) and
further kinds that are only suspected (provider tokens, signed web tokens, private key headers, random-looking strings). Each
candidate's secret part is hashed. Across the corpus, the hash is counted by distinct repositories and distinct owners: a value
that many owners carry is a copied example, one that a single owner carries looks live. Base spans are always reported;
suspected spans are reported only where their value looks live. `scan` also labels every span `live` or `example`.

The counting works on distinct (hash, repository, owner) rows after map-side aggregation; no list of a value's places is ever
gathered. Texts are read once; what follows works on the table of candidates.

Defined results: null text is empty and has no span; overlapping spans of different kinds are all kept, but a suspected span that
touches a base span is not; null repositories or owners count as one repository or owner; repeated rows each get their row and
count once; very long texts are scanned whole; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import stored, table

KINDS = ("assign", "access", "hex", "provider", "webtoken", "privatekey", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
PROVIDER = re.compile(r"(?:gh[pousr]_[A-Za-z0-9]{30,}|xox[abprs]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{30,}|sk_live_[A-Za-z0-9]{16,})")
WEBTOKEN = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----")
RANDOM = re.compile(r"[A-Za-z0-9+/_=-]{24,}")
#: Bits a character from which a string with digits and both cases counts as random-looking.
ENTROPY = 3.8
#: A value that at least so many distinct owners carry, or so many repositories, is a copied example.
OWNERS, REPOSITORIES = 3, 25


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, secret part), sorted."""
    found = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def suspected(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    found = [(m.start(), k, m.end(), m[0]) for k, rx in ((3, PROVIDER), (4, WEBTOKEN), (5, PRIVATE)) for m in rx.finditer(text)]
    for m in RANDOM.finditer(text):
        s = m[0]
        if re.search("[0-9]", s) and re.search("[a-z]", s) and re.search("[A-Z]", s) and entropy(s) >= ENTROPY:
            found.append((m.start(), 6, m.end(), s))
    cover: list[list[int]] = []  # base spans, joined where they touch or overlap
    for a, _, b, _ in base:
        if cover and a <= cover[-1][1]:
            cover[-1][1] = max(cover[-1][1], b)
        else:
            cover.append([a, b])
    starts = [x[0] for x in cover]
    out: list[tuple[int, int, int, str]] = []
    for x in sorted(found):
        k = bisect_left(starts, x[2]) - 1  # the last that starts before the span's end
        if (k < 0 or cover[k][1] <= x[0]) and (not out or out[-1][2] <= x[0]):
            out.append(x)
    return out


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("hash", pa.int64())])
PLACE = "struct<start: bigint, kind: int, end: bigint, hash: bigint>"


def candidates(docs: DataFrame, id_col: str, text_col: str, repository_col: str, owner_col: str) -> DataFrame:
    """A stored table: row, id, repository, owner, base counts and digest, and the array of candidate spans of each text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(3).to_pylist():
                base = base_spans(text) if text else []
                more = suspected(text, base) if text else []
                n = Counter(x[1] for x in base)
                spans = [{"start": a, "kind": k, "end": b, "hash": xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), 42) - (1 << 63)} for a, k, b, s in sorted(base + more)]
                rows.append((n[0], n[1], n[2], hashlib.sha256(told([x[:3] for x in base]).encode()).hexdigest(), spans))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN))
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *cols], ["id", "repository", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "places"])

    source = docs.select(docs[id_col].alias("id"), docs[repository_col].cast("string").alias("repository"), docs[owner_col].cast("string").alias("owner"), docs[text_col].cast("string").alias("text"))
    found = source.mapInArrow(run, f"id {kind}, repository string, owner string, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, places array<{PLACE}>")
    return stored(found.withColumn("row", F.monotonically_increasing_id()), "secrets")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners, looks) of every candidate value of the corpus."""
    each = found.select("repository", "owner", F.explode("places").alias("p")).select(F.col("p.hash").alias("hash"), "repository", "owner").distinct()
    counts = each.groupBy("hash").agg(F.count_distinct(F.coalesce("repository", F.lit("\x00"))).alias("repositories"), F.count_distinct(F.coalesce("owner", F.lit("\x00"))).alias("owners"))
    return counts.withColumn("looks", F.when((F.col("owners") >= OWNERS) | (F.col("repositories") >= REPOSITORIES), "example").otherwise("live"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repository_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """One row per input row: id, n_assign, n_access, n_hex, base_sha256, and found: the sorted array of (start, kind, end, looks, owners, repositories)."""
    found = candidates(docs, id_col, text_col, repository_col, owner_col)
    spans = found.where(F.size("places") > 0).select("row", F.explode("places").alias("p")).select("row", "p.*")
    judged = spans.join(ownership(found), "hash").where((F.col("kind") < 3) | (F.col("looks") == "live"))
    by_row = judged.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end", "looks", "owners", "repositories"))).alias("found"))
    out = found.drop("places", "repository", "owner").join(by_row, "row", "left")
    return out.select(F.col("id").alias(id_col), "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce("found", F.array().cast(by_row.schema["found"].dataType)).alias("found"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents"))
    names = F.array(*[F.lit(k) for k in KINDS])
    say = lambda x: F.concat_ws(":", names[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))
    live = F.size(F.filter("found", lambda x: x["looks"] == "live")).cast("long")
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(F.transform("found", say), ",").alias("spans"), live.alias("n_live"))
