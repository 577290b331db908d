"""From hits to the context of an answer: hydration, parents, packing, neighbours, merging, citations."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.fusion import flat
from corvane.storage import light_batches

SHORT, LONG = 240, 1200
DOCUMENTS = 64  # whose chunks a worker walks at once


def hydrate(hits: DataFrame, chunks: DataFrame, default_scope: bool) -> DataFrame:
    """Hits with their chunk's content where theirs is blank. In an explicit scope, hits whose chunk is not there go."""
    c = chunks.select("chunk_id", F.col("content").alias("stored"), F.lit(True).alias("there"))
    rows = hits.join(c, "chunk_id", "left")
    if not default_scope:
        rows = rows.where("there")
    return rows.withColumn("content", F.coalesce(F.when(F.trim("content") != "", F.col("content")), "stored", F.lit(""))).drop("stored", "there")


def recall_parents(hits: DataFrame, chunks: DataFrame, score: Column) -> DataFrame:
    """One row per (query, parent): the parent's content, the best score of its children and the children found, best first.

    Tables stand for themselves; hits whose parent does not exist go.
    """
    rows = hits.withColumn("s", score).withColumn("pid", F.when(F.col("chunk_type") == "table", F.col("chunk_id")).otherwise(F.coalesce("parent_id", "chunk_id")))
    found = rows.groupBy("query_id", "pid").agg(F.max("s").alias("score"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("s")).alias("o"), "chunk_id"))), lambda x: x["chunk_id"]).alias("children"))
    parents = chunks.select(F.col("chunk_id").alias("pid"), "doc_id", "content", "token_count")
    return found.join(parents, "pid").withColumnRenamed("pid", "parent_id")


def pack(parents: DataFrame, budget: int) -> DataFrame:
    """Best parents first while the budget lasts: one that does not fit is skipped and later ones still tried; the first always stays.

    A fold over a query's short, sorted list. Adds position (from 1) and used (tokens so far).
    """
    item = F.struct((-F.round("score", 12)).alias("o"), F.col("parent_id").alias("parent_id"), F.col("token_count").cast("int").alias("n"))
    lists = parents.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    kept = F.array().cast("array<struct<parent_id:string,n:int,used:int>>")

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["n"] <= budget)
        more = F.concat(acc["kept"], F.array(F.struct(x["parent_id"].alias("parent_id"), x["n"].alias("n"), (acc["used"] + x["n"]).alias("used"))))
        return F.struct(F.when(fits, more).otherwise(acc["kept"]).alias("kept"), F.when(fits, acc["used"] + x["n"]).otherwise(acc["used"]).alias("used"))

    folded = F.aggregate("items", F.struct(kept.alias("kept"), F.lit(0).alias("used")), step)
    return lists.select("query_id", F.posexplode(folded["kept"]).alias("position", "k")).select("query_id", (F.col("position") + 1).alias("position"), "k.parent_id", F.col("k.n").alias("token_count"), F.col("k.used").alias("used"))


def batches(rows: DataFrame, limit: int, key: str = "id", order: str = "seq", size: str = "token_count") -> DataFrame:
    """key, order and batch (from 0): a new batch begins where the running size would pass the limit."""
    items = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(size).cast("int").alias("n")))).alias("items"))

    # the walk notes where batches begin; each then takes its slice, so that the work grows with the items alone
    def step(acc: Column, x: Column) -> Column:
        over = (acc["used"] > 0) & (acc["used"] + x["n"] > limit)
        begins = F.when(over, F.concat(acc["begins"], F.array(acc["place"]))).otherwise(acc["begins"])
        return F.struct(F.when(over, x["n"]).otherwise(acc["used"] + x["n"]).alias("used"), (acc["place"] + 1).alias("place"), begins.alias("begins"))

    start = F.struct(F.lit(0).alias("used"), F.lit(1).alias("place"), F.array(F.lit(1)).alias("begins"))
    walked = items.select(key, "items", F.aggregate("items", start, step)["begins"].alias("begins"))
    sliced = walked.select(key, "items", "begins", F.posexplode("begins").alias("batch", "begin"))
    until = F.coalesce(F.get("begins", F.col("batch") + 1), F.size("items") + 1)
    sliced = sliced.select(key, "batch", F.explode(F.slice("items", F.col("begin"), until - F.col("begin"))).alias("b"))
    return sliced.select(key, F.col("b.at").alias(order), "batch")


def _widened(lengths: list[int], i: int, short: int, long: int) -> tuple[int, int]:
    """First and last sibling that chunk i takes in, by turns before and after, until they have `short` characters together."""
    left, right, size = i, i, lengths[i]
    while size < short:
        grew = False
        if left > 0:
            left, grew = left - 1, True
            size += lengths[left] + 2 * bool(size and lengths[left])
        if size >= short:
            break
        if right < len(lengths) - 1:
            right, grew = right + 1, True
            size += lengths[right] + 2 * bool(size and lengths[right])
        if not grew or size >= long:
            break
    return left, right


def expand_short(chunks: DataFrame, short: int = SHORT, long: int = LONG) -> DataFrame:
    """Chunks shorter than `short` with siblings added by turns before and after until they reach it, cut at `long`. Adds neighbours.

    A chunk needs few siblings, but how many depends on their lengths, so a document's chunks are gathered in one row and walked there, many documents to a batch.
    """
    light_batches(chunks.sparkSession)
    kind = dict(chunks.dtypes)["doc_id"]
    rows = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("seq").isNull().alias("last"), "seq", "chunk_id", "content"))).alias("rows"))
    rows = rows.select("doc_id", F.col("rows.chunk_id").alias("ids"), F.col("rows.content").alias("contents"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, DOCUMENTS) for b in batches for start in range(0, b.num_rows, DOCUMENTS)):
            place, chunk_ids, out, near = [], [], [], []
            for k, (ids, contents) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                texts = [t.strip() for t in contents]
                lengths = list(map(len, texts))
                for i, content in enumerate(contents):
                    left, right = _widened(lengths, i, short, long)
                    said = content
                    if left < right:
                        said = "\n\n".join([t for t in texts[left : right + 1] if t])
                        said = said if len(said) <= long else said[:long].rstrip()
                    out.append(said)
                    near.append(ids[left:i] + ids[i + 1 : right + 1])
                place += [k] * len(ids)
                chunk_ids += ids
            columns = [batch.column(0).take(pa.array(place, pa.int32())), pa.array(chunk_ids, pa.string()), pa.array(out, pa.string()), pa.array(near, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "chunk_id", "content", "neighbours"])

    return rows.mapInArrow(run, f"doc_id {kind}, chunk_id string, content string, neighbours array<string>")


def overlapping(left: str, right: str) -> bool:
    """One holds the other, or the shorter's first or last characters (up to 120, 24 at least)."""
    a, b = sorted((flat(left), flat(right)), key=len)
    if not a:
        return False
    n = min(len(a), 120)
    return a in b or n >= 24 and (a[-n:] in b or a[:n] in b)


def merge_contexts(hits: DataFrame) -> DataFrame:
    """Hits of one document that share a parent, a signature or an overlap become one: contents joined, ids gathered, pages widened.

    Input: a short list a query, in the order of `position`.
    """
    schema = "query_id bigint, position int, doc_id string, content string, chunk_ids array<string>"

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for r in rows.sort_values("position").itertuples(index=False):
            own = r.parent_id or r.chunk_id
            home = next((o for o in out if o["doc_id"] == r.doc_id and (own in o["keys"] or flat(o["content"])[:500] == flat(r.content)[:500] or overlapping(o["content"], r.content))), None)
            if home is None:
                out.append({"query_id": r.query_id, "position": len(out) + 1, "doc_id": r.doc_id, "content": r.content, "chunk_ids": [r.chunk_id], "keys": {own}})
                continue
            if flat(r.content) not in flat(home["content"]):
                home["content"] = r.content if flat(home["content"]) in flat(r.content) else home["content"] + "\n\n" + r.content
            home["chunk_ids"] += [r.chunk_id] if r.chunk_id not in home["chunk_ids"] else []
        return pd.DataFrame(out, columns=["query_id", "position", "doc_id", "content", "chunk_ids", "keys"]).drop(columns="keys")

    return hits.groupBy("query_id").applyInPandas(one, schema)


def context_text(rows: DataFrame) -> DataFrame:
    """query_id, context: numbered blocks of source and content, in the order of `position`."""
    block = F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), F.coalesce("source", F.lit("unknown")), F.lit("\n"), F.col("content"))
    return rows.withColumn("block", block).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "block"))), lambda x: x["block"]), "\n\n").alias("context"))


def verify_citations(cited: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(citations whose chunk exists, those whose chunk does not)."""
    ids = chunks.select("chunk_id")
    return cited.join(ids, "chunk_id", "left_semi"), cited.join(ids, "chunk_id", "left_anti")


def extractive_answer(question: Column, context: Column, sentences: int = 3) -> Column:
    """The default answer without a model: the context's sentences that share most tokens with the question."""
    parts = F.filter(F.transform(F.split(context, r"(?<=[.!?。])\s+"), lambda s: F.trim(s)), lambda s: s != "")
    q = X.query_terms(question)
    scored = F.transform(parts, lambda s, i: F.struct((-F.size(F.array_intersect(q, X.index_tokens(s)))).alias("o"), i.alias("i"), s.alias("s")))
    best = F.slice(F.array_sort(scored), 1, sentences)
    return F.array_join(F.transform(F.array_sort(F.transform(best, lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))), lambda x: x["s"]), " ")


def last_n(messages: DataFrame, n: int, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """The last n messages of each conversation, oldest first."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return messages.withColumn("back", F.row_number().over(w)).where(F.col("back") <= n).drop("back").orderBy(key, order)
