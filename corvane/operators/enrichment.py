"""Summaries, keywords and suggested questions of documents, made in two phases.

A document's chunks go into batches of at most a number of tokens, in order; a provider works on each batch; where a document had several, their
summaries are numbered, batched again under the same bound and given to the provider, round after round, until one is left. So no provider
ever sees more than the bound (but for a single chunk that alone is larger), however long the document is, and a document's batches
are worked on by different tasks.

The default provider ranks sentences by centrality: the sum of the cosines of a sentence's term counts with those of all other sentences of the
text. As cosines are linear in the normalised counts, that is one product with their sum, linear in the text, without a matrix of pairs.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.context import batches
from corvane.storage import stored

# Bounds, the label of a partial summary, the message without chunks.
MAX_TOKENS, LEAST_TOKENS, MAX_RETRIES = 6000, 500, 2
SUMMARY_CHARS, KEYWORDS, KEYWORD_CHARS, QUESTIONS, QUESTION_CHARS = 1200, 12, 80, 8, 200
PART = "分段 "
NO_PARENTS = "Document has no parent chunks for enrichment"

#: Sentences of a summary; keywords have so many characters at least; questions are asked about so many keywords.
SENTENCES, KEYWORD_LEAST, ASKED = 3, 4, 3
RESULT = "summary string, keywords array<string>, suggested_questions array<string>, error string"
#: texts (doc_id, batch, name, text, partial) -> doc_id, batch and RESULT
Provider = Callable[[DataFrame], DataFrame]


def sentences(text: Column) -> Column:
    """Parts that end at a line's end or at a mark before a blank; trimmed, none empty."""
    marked = F.regexp_replace(text, r"([.!?。！？])[ \t\n\r\f\x0B]+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def bounded_unique(values: list, most: int, chars: int) -> list[str]:
    """The first `most` different values, stripped and cut."""
    cut = (str(v).strip()[:chars] for v in values)
    return list(dict.fromkeys(filter(None, cut)))[:most]


def central(said: list[str], tokens: list[list[str]], name: str, limit: int = SUMMARY_CHARS) -> tuple[str, list[str], list[str]]:
    """Summary, keywords and questions of a text of sentences: the most central ones in their order, and the terms that weigh most in all."""
    rows = []
    total: dict[str, float] = {}
    for words in tokens:
        counts = Counter(words)
        norm = math.sqrt(sum(n * n for n in counts.values()))
        rows.append((counts, norm))
        for t, n in counts.items():
            total[t] = total.get(t, 0.0) + n / norm
    centrality = [round(sum(n / norm * total[t] for t, n in counts.items()) - 1, 9) if counts else -1.0 for counts, norm in rows]
    best = sorted(sorted(range(len(said)), key=lambda i: (-centrality[i], i))[:SENTENCES])
    terms = sorted((t for t in total if len(t) >= KEYWORD_LEAST), key=lambda t: (-round(total[t], 9), t))
    keywords = bounded_unique(terms[:KEYWORDS], KEYWORDS, KEYWORD_CHARS)
    return " ".join(said[i] for i in best)[:limit], keywords, bounded_unique([f"What does {name} say about {t}?" for t in keywords[:ASKED]], QUESTIONS, QUESTION_CHARS)


def centrality_provider(limit: int = SUMMARY_CHARS) -> Provider:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = [central(*row, limit) for row in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            made = [pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made, pa.nulls(part.num_rows, pa.string())], ["doc_id", "batch", "summary", "keywords", "suggested_questions", "error"])

    def provide(texts: DataFrame) -> DataFrame:
        rows = texts.select("doc_id", "batch", sentences(F.col("text")).alias("said"), F.coalesce("name", "doc_id").alias("name"))
        rows = rows.select("doc_id", "batch", "said", F.transform("said", X.index_tokens).alias("tokens"), "name")
        return rows.mapInArrow(run, f"doc_id string, batch int, {RESULT}")

    return provide


def row_provider(generate: Callable[[str, str, bool], dict], model: str = "") -> Provider:
    """A provider of a function (name, text, partial) that returns a dict or raises; what it raises becomes the batch's error."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            out = []
            for name, text, partial in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                try:
                    r = generate(name, text, partial)
                    out.append((str(r.get("summary") or "")[:SUMMARY_CHARS], bounded_unique(r.get("keywords") or [], KEYWORDS, KEYWORD_CHARS), bounded_unique(r.get("suggested_questions") or [], QUESTIONS, QUESTION_CHARS), None))
                except Exception as e:  # one document's failure is told in its row
                    out.append((None, None, None, str(e) or type(e).__name__))
            kinds = (pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array([r[i] for r in out], k) for i, k in enumerate(kinds))], ["doc_id", "batch", "summary", "keywords", "suggested_questions", "error"])

    return lambda texts: texts.select("doc_id", "batch", F.coalesce("name", "doc_id").alias("name"), "text", "partial").mapInArrow(run, f"doc_id string, batch int, {RESULT}")


def sanitized(error: Column) -> Column:
    """Without credentials, a thousand characters at most."""
    said = F.regexp_replace(error, r"(?i)bearer\s+\S+", "Bearer [redacted]")
    return F.left(F.regexp_replace(said, r"(?i)(api[_-]?key|authorization)\s*[:=]\s*\S+", "$1=[redacted]"), F.lit(1000))


def batched(chunks: DataFrame, names: DataFrame, most: int) -> DataFrame:
    """doc_id, batch, name, text, partial, ids: chunks (doc_id, seq, chunk_id, content, token_count) of one batch, joined by empty lines.

    Batches, their number and the names are put together without the texts, which then move twice: to meet their batch, and to be joined.
    """
    thin = batches(chunks.select("doc_id", "seq", "token_count"), most, key="doc_id").select("doc_id", "seq", F.col("batch").cast("int").alias("batch"))
    partial = thin.groupBy("doc_id").agg((F.max("batch") > 0).alias("partial"))
    thin = thin.join(partial.join(names, "doc_id"), "doc_id")
    rows = chunks.select("doc_id", "seq", "chunk_id", "content").join(thin, ["doc_id", "seq"])
    rows = rows.groupBy("doc_id", "batch", "name", "partial").agg(F.array_sort(F.collect_list(F.struct("seq", "chunk_id", "content"))).alias("c"))
    return rows.select("doc_id", "batch", "name", F.array_join("c.content", "\n\n").alias("text"), "partial", F.col("c.chunk_id").alias("ids"))


def enrich(documents: DataFrame, parents: DataFrame, provider: Provider | None, model: str = "centrality", most: int = MAX_TOKENS, versions: DataFrame | None = None) -> DataFrame:
    """doc_id, status, summary, keywords, suggested_questions, error, model_ref, source_chunk_ids, batches, version of every document.

    documents: doc_id, name. parents: doc_id, seq (unique in a document), chunk_id, content, token_count or null. A document without
    parents fails, one with a failed batch too; without a provider the status is none. versions (doc_id, version) counts earlier tries.
    A document's source_chunk_ids and batch numbers are gathered in one row each; its text never is, beyond a batch.
    """
    most = max(LEAST_TOKENS, most)
    if provider is None:
        nothing = [F.lit(None).cast(k).alias(c) for c, k in (("summary", "string"), ("keywords", "array<string>"), ("suggested_questions", "array<string>"))]
        return documents.select("doc_id", F.lit("none").alias("status"), *nothing, F.lit("").alias("error"), F.lit("").alias("model_ref"), F.array().cast("array<string>").alias("source_chunk_ids"), F.lit(0).alias("batches"), F.lit(0).alias("version"))
    names = documents.select("doc_id", "name")
    estimate = F.greatest(F.lit(1), F.coalesce(F.when(F.col("token_count") > 0, F.col("token_count")), F.floor(F.length("content") / 4)))
    rows = parents.select("doc_id", "seq", "chunk_id", F.coalesce("content", F.lit("")).alias("content"), estimate.cast("int").alias("token_count"))
    made = stored(batched(rows, names, most), "enrich-batches")
    counts = made.groupBy("doc_id").agg(F.count(F.lit(1)).cast("int").alias("batches"))
    sources = made.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch", "ids"))), lambda x: x["ids"])).alias("source_chunk_ids"))
    todo, failed, finished = made.drop("ids"), None, None
    while True:
        # what was said of each batch; a document with a failed batch is failed, one with a single batch is finished
        said = stored(provider(todo), "enrich-said")
        state = said.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("batch"))).alias("error"))
        state = stored(state, "enrich-state")
        bad = state.where("error IS NOT NULL").select("doc_id", sanitized(F.col("error")).alias("error"))
        good = said.join(state.where("error IS NULL AND n = 1").select("doc_id"), "doc_id", "left_semi").select("doc_id", "summary", "keywords", "suggested_questions")
        failed = bad if failed is None else failed.unionByName(bad)
        finished = good if finished is None else finished.unionByName(good)
        more = state.where("error IS NULL AND n > 1").select("doc_id")
        if more.isEmpty():
            break
        # summaries are cut so that at least two fit the bound: every round leaves fewer
        label = F.concat(F.lit(PART), (F.col("batch") + 1).cast("string"), F.lit(": "))
        parts = said.join(more, "doc_id", "left_semi").select("doc_id", F.col("batch").alias("seq"), F.col("batch").cast("string").alias("chunk_id"), F.concat(label, F.left("summary", F.lit(2 * most - 20))).alias("content"))
        todo = stored(batched(parts.withColumn("token_count", X.estimate_tokens(F.col("content"))), names, most), "enrich-batches").drop("ids")
    tries = documents.select("doc_id", F.lit(0).alias("earlier")) if versions is None else versions.select("doc_id", F.col("version").alias("earlier"))
    out = documents.select("doc_id").join(counts, "doc_id", "left").join(sources, "doc_id", "left").join(finished, "doc_id", "left").join(failed.withColumnRenamed("error", "said"), "doc_id", "left").join(tries, "doc_id", "left")
    error = F.when(F.col("batches").isNull(), F.lit(NO_PARENTS)).otherwise(F.coalesce("said", F.lit("")))
    return out.select("doc_id", F.when(error == "", "completed").otherwise("failed").alias("status"), "summary", "keywords", "suggested_questions", error.alias("error"), F.lit(model).alias("model_ref"), F.coalesce("source_chunk_ids", F.array().cast("array<string>")).alias("source_chunk_ids"), F.coalesce("batches", F.lit(0)).alias("batches"), (F.coalesce("earlier", F.lit(0)) + 1).alias("version"))


def retry(enriched: DataFrame, documents: DataFrame, parents: DataFrame, provider: Provider, model: str = "centrality", most: int = MAX_TOKENS, max_retries: int = MAX_RETRIES) -> DataFrame:
    """enriched, with failed documents that have tries left worked on again; those beyond the limit stay as they are."""
    again = stored(enriched.where((F.col("status") == "failed") & (F.col("version") <= max_retries)).select("doc_id", "version"), "enrich-again")
    new = enrich(documents.join(again, "doc_id", "left_semi"), parents, provider, model, most, again)
    return enriched.join(again.select("doc_id"), "doc_id", "left_anti").unionByName(new)
