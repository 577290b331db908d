"""What each quality filter removes, alone and in any order, from signed parity sums.

A document's failures are a mask of bits, one a filter. Per part and label, Spark sums (-1)^popcount(mask & k) over the documents
for each of the 2^n values of k: a Walsh-Hadamard transform of the counts of masks, of fixed width whatever the data. Its inverse
is the same transform divided by 2^n, exact in integers, and gives the number of documents of every mask. All that is
asked of any order of the filters follows from these cells, without another look at a document; so does the Shapley value, as in
n! orders a document that fails s filters is removed n!/s times by each of them.

Equal texts are told by digest. The smallest id of a digest is found by an aggregation, and rows meet it on (digest, id), so a text
that a third of all rows share is dealt out by id and gathered nowhere. Parity sums aggregate before their shuffle.

Defined results
* null text is the empty text; null part is the empty string, together with parts that are empty strings.
* a null id is neither smaller nor larger than another: such rows never fail E and make no other row fail it.
* repeated rows count each; those with the same id and text are no copies of each other.
* several labels of one id: good if any says quality 1, toxic if any says toxic 1; none or null: neither.
* very long texts are read whole; an empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import json
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import UPPER, stored, table, whole

FEW_WORDS, DISTINCT_PERCENT, UPPER_PERCENT, MARKS = 50, 65, 5, r"[#$%&*|]"
#: The last filter, a copy of an earlier text, is the only one that looks beyond its document.
LETTERS = "ABCDE"


def own_failures(text: Column) -> Column:
    """Bits 0 to 3: what a text fails by itself, as an int."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n = F.size(words)
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    fails = (n < FEW_WORDS, 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * F.length(text), text.rlike(MARKS))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", good_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """(part, good, toxic, mask) of every row of docs; bit i of mask is set if the row fails LETTERS[i]."""
    text = whole(docs, text_col)
    part = F.coalesce(docs[part_col].cast("string"), F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), part.alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_failures(text).alias("own"))
    rows = stored(rows, "audit-rows")
    first = rows.groupBy("digest").agg(F.min("id").alias("id")).where("id IS NOT NULL").withColumn("first", F.lit(True))
    marked = rows.join(first, ["digest", "id"], "left")
    said = lambda c: F.max(F.coalesce(labels[c] == 1, F.lit(False)))
    known = labels.where(labels[id_col].isNotNull()).groupBy(labels[id_col].alias("id")).agg(said(good_col).alias("good"), said(toxic_col).alias("toxic"))
    copy = F.when(F.col("id").isNull() | F.col("first"), 0).otherwise(1 << 4)
    mark = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return marked.join(known, "id", "left").select("part", mark("good"), mark("toxic"), (F.col("own") + copy).alias("mask"))


def sign(a: Column, b: Column) -> Column:
    """(-1)^popcount(a & b)."""
    return 1 - 2 * F.bit_count(a.bitwiseAND(b)).bitwiseAND(F.lit(1))


def parity_sums(rows: DataFrame, by: list[str], n: int, mask_col: str = "mask") -> DataFrame:
    """by, and sums: at place k the sum of sign(mask, k) over the group's rows, for k below 2^n."""
    sums = [F.sum(sign(rows[mask_col], F.lit(k)).cast("long")).alias(f"s{k}") for k in range(1 << n)]
    return rows.groupBy(*by).agg(*sums).select(*by, F.array(*[F.col(f"s{k}") for k in range(1 << n)]).alias("sums"))


def cells(sums: Column, n: int) -> Column:
    """The inverse of parity_sums: at place m the number of rows whose mask is m."""
    places = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    at = lambda m: F.aggregate(places, F.lit(0).cast("long"), lambda a, k: a + sign(m, k) * F.get(sums, k))
    return F.transform(places, lambda m: F.shiftright(at(m), n))


def steps(letters: str) -> Column:
    """Every order's steps as an array of (filter_order, step, before, own): bits of the filters that ran before, and of this one."""
    bit = {c: 1 << i for i, c in enumerate(letters)}
    rows = [{"filter_order": "".join(o), "step": i + 1, "before": sum(bit[c] for c in o[:i]), "own": bit[c]} for o in permutations(letters) for i, c in enumerate(o)]
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order: string, step: int, before: int, own: int>>")


def report(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """(part, good, toxic, mask) rows -> part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    n = len(letters)
    places = F.sequence(F.lit(0), F.lit((1 << n) - 1))
    per_label = parity_sums(rows, ["part", "good", "toxic"], n).select("part", "good", "toxic", cells(F.col("sums"), n).alias("cells"))
    # at most four rows a part
    parts = per_label.groupBy("part").agg(F.collect_list(F.struct("good", "toxic", "cells")).alias("labels"))

    def added(keep: Column) -> Column:
        at = lambda m: F.aggregate(keep, F.lit(0).cast("long"), lambda a, x: a + F.get(x["cells"], m))
        return F.transform(places, at)

    sums = {"every": F.col("labels"), "good": F.filter("labels", lambda x: x["good"]), "toxic": F.filter("labels", lambda x: x["toxic"])}
    # the cells are worked out once a part, before the orders multiply the rows
    parts = parts.select("part", *[added(c).alias(k) for k, c in sums.items()])
    parts = parts.select("*", F.explode(steps(letters)).alias("s")).select("part", "every", "good", "toxic", "s.*")
    before, own = F.col("before"), F.col("own")
    hit = lambda m, bits: m.bitwiseAND(bits) != 0

    def total(of: str, where) -> Column:
        return F.aggregate(places, F.lit(0).cast("long"), lambda a, m: a + F.when(where(m), F.get(F.col(of), m)).otherwise(0))

    gone = lambda m: hit(m, own) & ~hit(m, before)
    shares = F.array(*[F.lit(factorial(n) // s).cast("long") for s in range(1, n + 1)])
    share = F.aggregate(places, F.lit(0).cast("long"), lambda a, m: a + F.when(hit(m, own), F.get(F.col("every"), m) * F.get(shares, F.bit_count(m) - 1)).otherwise(0))
    return parts.select(
        "part",
        "filter_order",
        "step",
        total("every", lambda m: ~hit(m, before) & ~hit(m, own)).alias("kept"),
        total("every", gone).alias("removed"),
        total("every", lambda m: hit(m, own) & hit(m, before)).alias("redundant"),
        total("every", lambda m: m == own).alias("unique_fails"),
        total("good", gone).alias("good_lost"),
        total("toxic", gone).alias("toxic_lost"),
        share.alias("shapley"),
    )


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP13_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
o AS (SELECT text, min(doc_id) AS first FROM t GROUP BY text),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  len(words) < 50 AS a, 100 * len(list_distinct(words)) < 65 * len(words) AS b, 100 * length(regexp_replace(t.text, '[^A-Z]', '', 'g')) > 5 * length(t.text) AS c,
  regexp_matches(t.text, '[#$%&*|]') AS d, coalesce(t.doc_id > o.first, false) AS e
  FROM t JOIN o ON t.text = o.text LEFT JOIN l ON l.doc_id = t.doc_id),
m AS (SELECT part, good, toxic, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, count(*) AS n FROM f GROUP BY ALL),
x(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p AS (SELECT x1.letter || x2.letter || x3.letter || x4.letter || x5.letter AS filter_order, [x1.bit, x2.bit, x3.bit, x4.bit, x5.bit] AS bits
  FROM x x1, x x2, x x3, x x4, x x5 WHERE x1.bit | x2.bit | x3.bit | x4.bit | x5.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, list_sum(bits[1:step])::INT - bits[step] AS earlier FROM p, range(1, 6) r(step))
SELECT part, filter_order, step::INT AS step,
  coalesce(sum(n) FILTER (mask & (earlier | own) = 0), 0)::BIGINT AS kept,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (mask & own <> 0 AND mask & earlier <> 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
  coalesce(sum(n) FILTER (good AND mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS good_lost,
  coalesce(sum(n) FILTER (toxic AND mask & own <> 0 AND mask & earlier = 0), 0)::BIGINT AS toxic_lost,
  coalesce(sum(sum(n) FILTER (mask & own <> 0 AND mask & earlier = 0)) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley
FROM m, s GROUP BY part, filter_order, step, own, earlier
"""
