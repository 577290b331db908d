"""A kept keyword index: postings by term, in blocks that know their best score, with scopes and deltas.

A segment is what one commit adds. Its chunks are numbered in the order in which they are stored, and eight thousand neighbours are a block; a row of `blocks`
holds the postings of one term in one block, with the highest term frequency and the smallest length among them. Any chunk of the block scores at most
what these two give, whatever the average length has become, so a block's bound is right for every later state of the corpus. Neighbours come in one
Arrow batch, so postings are counted and packed where the chunks lie, and go to partitions by a hash of the term without a shuffle or a sort: a task
keeps a file of each partition open.
Scope columns stand beside the term: a search reads the partitions of the asked terms, and the scan leaves out other workspaces and knowledge bases.

A search reads the asked terms' rows, deals them out by block, and scores a block at a time: the bounds of a query's terms are added up first, and
the block's postings are looked at for those queries alone whose sum reaches the k-th best score that the task has seen. A chunk of any other block cannot be
among the k best, so the result equals scoring everything. A task passes on its k best a query, with all that tie; pairs of queries and chunks are never shuffled.

A document that comes again, or is deleted, is noted in `gone`; postings of it in earlier segments are left out on reading until `compact`
writes one segment of what lives. Document frequencies, the number of chunks and their average length are those of all living chunks, also
under a scope, which only says whose hits may be shown.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators.search import B, FLOOR, K1, blocks_of, top_k
from corvane.schemas import Scope
from corvane.storage import Versioned, stored

#: Chunks of a block; partitions by term.
BLOCK_CHUNKS, BUCKETS = 8192, 32
#: Files of a segment aimed at: a larger one is written by fewer tasks, though never by fewer than there are cores.
FILES = 4096
#: Queries that are scored against a block at once.
ASKED = 256
#: Replaced documents that are broadcast at most.
SENT = 1 << 19
#: Sums of the same numbers in another order differ by less.
SLACK = 1e-6
SCOPES = ("workspace_id", "knowledge_base_id")
ENTRY = pa.struct([("number", pa.int64()), ("tf", pa.int32()), ("dl", pa.int32())])
ROW = "term string, workspace_id string, knowledge_base_id string, segment int, block bigint, n int, tokens bigint, most_tf int, least_dl int, entries array<struct<number: bigint, tf: int, dl: int>>"


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def packed(chunks: DataFrame, segment: int) -> DataFrame:
    """Rows of `blocks` of a stored table of numbered chunks. A block that two batches share is two rows of its terms."""
    names = [x.split(" ")[0] for x in ROW.split(", ")][:10]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2 * BLOCK_CHUNKS):
                part = batch.slice(at, 2 * BLOCK_CHUNKS)
                tokens, number = part.column(0), part.column(1).to_numpy(zero_copy_only=False)
                dl = pc.list_value_length(tokens).fill_null(0).to_numpy(zero_copy_only=False)
                coded = tokens.flatten().dictionary_encode()
                if not len(coded):
                    continue
                width = len(coded.dictionary)
                seen, tf = np.unique(np.repeat(np.arange(part.num_rows), dl) * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
                row, term = seen // width, seen % width
                # a group is a term in a block and a scope
                scope = np.zeros(part.num_rows, np.int64)
                for i in (2, 3):
                    own = part.column(i).dictionary_encode(null_encoding="encode")
                    scope = scope * max(1, len(own.dictionary)) + own.indices.to_numpy(zero_copy_only=False)
                block = number // BLOCK_CHUNKS
                order = np.lexsort((number[row], scope[row], block[row], term))
                row, term, tf = row[order], term[order], tf[order]
                new = np.concatenate([[True], (term[1:] != term[:-1]) | (block[row][1:] != block[row][:-1]) | (scope[row][1:] != scope[row][:-1])])
                first = np.flatnonzero(new)
                entries = pa.StructArray.from_arrays([pa.array(number[row]), pa.array(tf, pa.int32()), pa.array(dl[row], pa.int32())], fields=list(ENTRY))
                lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), entries)
                at_row = pa.array(row[first])
                columns = [coded.dictionary.take(pa.array(term[first])), part.column(2).take(at_row), part.column(3).take(at_row), pa.array(np.full(len(first), segment), pa.int32()), pa.array(block[row[first]])]
                columns += [pa.array(np.diff(np.append(first, len(row))), pa.int32()), pa.array(np.add.reduceat(tf, first), pa.int64()), pa.array(np.maximum.reduceat(tf, first), pa.int32()), pa.array(np.minimum.reduceat(dl[row], first), pa.int32()), lists]
                yield pa.RecordBatch.from_arrays(columns, names)

    return chunks.select(X.index_tokens(chunks["content"]).alias("tokens"), "number", *SCOPES).mapInArrow(run, ROW)


class Best:
    """The k best chunks of each query that a task has seen, and all that tie with the last of them, to nine places."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.least = k, np.zeros(queries)
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def offer(self, query: int, segment: int, number: np.ndarray, score: np.ndarray) -> None:
        where = np.full(len(number), segment)
        if query in self.held:
            where, number, score = (np.concatenate(x) for x in zip(self.held[query], (where, number, score)))
        if len(score) >= self.k:
            near = np.round(score, 9)
            edge = np.partition(near, len(near) - self.k)[len(near) - self.k]
            good = near >= edge
            where, number, score, self.least[query] = where[good], number[good], score[good], edge
        self.held[query] = where, number, score

    def batch(self, ids: list[int]) -> pa.RecordBatch:
        parts = [(np.full(len(s), ids[q]), w, n, s) for q, (w, n, s) in self.held.items()]
        columns = [np.concatenate([p[i] for p in parts]) if parts else np.array([]) for i in range(4)]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, t in zip(columns, kinds)], ["query_id", "segment", "number", "bm25"])


def scored_block(best: Best, segment: int, rows: pa.Table, terms: list[str], begins: np.ndarray, query: np.ndarray, idf: np.ndarray, avgdl: float) -> None:
    """Offers to best what a block's rows (term, most_tf, least_dl, numbers, tfs, dls) hold. Queries of term i stand at begins[i] to begins[i + 1]."""
    rows = rows.combine_chunks()
    worth = lambda tf, dl: tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
    plain = lambda name: rows.column(name).to_numpy()
    term = np.searchsorted(np.array(terms, object), np.array(rows.column("term").to_pylist(), object))
    asks = begins[term + 1] - begins[term]
    row = np.repeat(np.arange(len(term)), asks)
    at = np.arange(len(row)) - np.repeat(np.cumsum(asks) - asks, asks) + np.repeat(begins[term], asks)
    who, weight = query[at], idf[at]
    bound = np.bincount(who, weight * worth(plain("most_tf"), plain("least_dl"))[row], len(best.least))
    hopeful = np.flatnonzero((bound > 0) & (bound >= best.least - SLACK))
    if not len(hopeful):
        return
    lists = rows.column("numbers").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy()
    starts = np.cumsum(sizes) - sizes
    flat = lambda name: rows.column(name).combine_chunks().flatten().to_numpy()
    number, chunk = np.unique(flat("numbers"), return_inverse=True)
    value = worth(flat("tfs"), flat("dls"))
    for k in range(0, len(hopeful), ASKED):
        some = hopeful[k : k + ASKED]
        local = np.full(len(best.least), -1)
        local[some] = np.arange(len(some))
        use = np.flatnonzero(local[who] >= 0)
        n = sizes[row[use]]
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[row[use]], n)
        key = np.repeat(local[who[use]] * len(number), n) + chunk[entry]
        scores = np.bincount(key, np.repeat(weight[use], n) * value[entry], len(some) * len(number)).reshape(len(some), len(number))
        for i, q in enumerate(some.tolist()):
            good = np.flatnonzero((scores[i] > 0) & (scores[i] >= best.least[q] - SLACK))
            if len(good):
                best.offer(q, segment, number[good], scores[i][good])


class KeywordIndex:
    """The tables chunks, blocks, sizes and gone of a Versioned store. A store may hold other tables beside them."""

    def __init__(self, store: Versioned, buckets: int = BUCKETS) -> None:
        self.store, self.spark, self.buckets = store, store.spark, buckets

    def _blocks(self, rows: DataFrame) -> dict[str, tuple[str, str]]:
        """Written folders of blocks and of their segment's size in tokens; a frequent term lies in the files of many tasks.

        Rows go to their files as they come, in the order of terms within a batch: sorting them by partition would spill many times the corpus.
        """
        tasks = max(FILES // self.buckets, self.spark.sparkContext.defaultParallelism)
        rows = rows.coalesce(tasks).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        blocks = self.store.write(rows, "blocks", ("bucket",), self.buckets)
        sizes = self.store.part(blocks).agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
        return {"blocks": blocks, "sizes": self.store.write(sizes, "sizes")}

    def numbered(self, chunks: DataFrame) -> tuple[str, str]:
        """The written, uncommitted folder of the next segment's chunks."""
        number = F.monotonically_increasing_id().alias("number")
        return self.store.write(chunks.select(*SCOPES, "doc_id", "seq", "chunk_id", "content", number, F.lit(self.store.version + 1).alias("segment")), "chunks")

    def segment(self, chunks: DataFrame | tuple[str, str], renewed: DataFrame | None = None) -> dict[str, tuple[str, str]]:
        """Written, uncommitted folders of a segment that holds chunks (workspace_id, knowledge_base_id, doc_id, seq, chunk_id, content), and of the documents it replaces.

        chunks: rows, or a folder that `numbered` wrote at this version. renewed: doc_ids whose earlier state goes, if not those of chunks alone.
        """
        number = self.store.version + 1
        folder = chunks if isinstance(chunks, tuple) else self.numbered(chunks)
        written = {"chunks": folder, **self._blocks(packed(self.store.part(folder), number))}
        known = [t.select("doc_id") for t in map(self.store.table, ("chunks", "documents", "quarantine")) if t is not None]
        if known:
            seen = reduce(DataFrame.unionByName, known).distinct()
            again = (self.store.part(folder) if renewed is None else renewed).select("doc_id").distinct().join(seen, "doc_id", "left_semi").withColumn("before", F.lit(number))
            gone = self.store.write(again, "gone")
            if not self.store.part(gone).isEmpty():
                written["gone"] = gone
        return written

    def add(self, chunks: DataFrame, name: str | None = None) -> None:
        """Adds chunks, or replaces those of documents that are there already. A name that was added before changes nothing."""
        if name is None or self.store.done(name) is None:
            self.store.commit(self.segment(chunks), name)

    def delete(self, doc_ids: DataFrame) -> None:
        """Takes documents (column doc_id) out."""
        self.store.commit({"gone": self.store.write(doc_ids.select("doc_id").distinct().withColumn("before", F.lit(self.store.version + 1)), "gone")})

    def _gone(self) -> DataFrame | None:
        gone = self.store.table("gone")
        return None if gone is None else gone.groupBy(F.col("doc_id").alias("gone_id")).agg(F.max("before").alias("before"))

    def living(self, rows: DataFrame, segment: str = "segment", gone: bool = False) -> DataFrame:
        """rows (doc_id and the version that wrote them) without what a later version replaced or deleted, or those rows alone."""
        last = self._gone()
        if last is None:
            return rows.limit(0) if gone else rows
        return rows.join(last, (rows["doc_id"] == last["gone_id"]) & (rows[segment] < last["before"]), "left_semi" if gone else "left_anti")

    def chunks(self) -> DataFrame | None:
        rows = self.store.table("chunks")
        return None if rows is None else self.living(rows)

    def _flat(self, blocks: DataFrame) -> DataFrame:
        flat = blocks.select("term", *SCOPES, "segment", "block", F.explode("entries").alias("e")).select("term", *SCOPES, "segment", "block", "e.*")
        if self.store.table("gone") is None:
            return flat
        return flat.join(self.living(self.store.table("chunks"), gone=True).select("segment", "number"), ["segment", "number"], "left_anti")

    def postings(self) -> DataFrame:
        """term, tf, dl, number, segment and scope columns of every living posting."""
        return self._flat(self.store.table("blocks"))

    def totals(self, where: Column | None = None) -> DataFrame:
        """term, df, total of the living postings, or of those in the scopes that `where` names: sums over blocks, less what the chunks that are gone hold, whose texts alone are cut again."""
        shown = (lambda rows: rows) if where is None else (lambda rows: rows.where(where))
        rows = shown(self.store.table("blocks")).select("term", F.col("n").cast("bigint").alias("df"), F.col("tokens").alias("total"))
        last = self._gone()
        if last is None:
            return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
        chunks, few = shown(self.store.table("chunks")), self.store.table("gone").count() <= SENT
        dead = chunks.join(last.hint("broadcast") if few else last, (chunks["doc_id"] == last["gone_id"]) & (chunks["segment"] < last["before"]), "left_semi")
        less = lambda terms, df, total: F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(df).cast("bigint").alias("df"), F.lit(total).cast("bigint").alias("total")))
        tokens = dead.select(X.index_tokens(F.col("content")).alias("tokens"))
        out = tokens.select(F.explode(F.concat(less(F.array_distinct("tokens"), -1, 0), less(F.col("tokens"), 0, -1))).alias("t")).select("t.*")
        return rows.unionByName(out).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total").alias("total")).where("df > 0")

    def size(self) -> tuple[int, float]:
        """The number of living chunks and their average length: of all, less those that are gone, whose texts alone are cut again."""
        n = self.store.table("chunks").count()
        tokens = self.store.table("sizes").agg(F.sum("tokens")).first()[0] or 0
        if self.store.table("gone") is not None:
            dead = self.living(self.store.table("chunks"), gone=True).agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size(X.index_tokens(F.col("content")))), F.lit(0))).first()
            n, tokens = n - dead[0], tokens - dead[1]
        return n, tokens / n if n and tokens else 1.0

    def merged(self) -> dict[str, tuple[str, str]]:
        """Written, uncommitted folders of one segment of all that lives, to replace chunks, blocks, sizes and gone."""
        number = self.store.version + 1
        rows = self.chunks().withColumns({"number": F.monotonically_increasing_id(), "segment": F.lit(number)})
        folder = self.store.write(rows, "chunks")
        return {"chunks": folder, **self._blocks(packed(self.store.part(folder), number))}

    def compact(self) -> None:
        """One segment in place of the others. Where a store has further tables that `gone` speaks of, their owner compacts all of them together."""
        self.store.commit(self.merged(), replace=("chunks", "blocks", "sizes", "gone"))

    def _asked_blocks(self, terms: DataFrame) -> DataFrame:
        """Living blocks of the terms (term, bucket), read from their partitions only."""
        buckets = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most self.buckets numbers
        return self.store.table("blocks").where(F.col("bucket").isin(buckets)).join(terms.select("term"), "term", "left_semi")

    def search(self, queries: DataFrame, k: int, scope: Scope | None = None) -> DataFrame:
        """query_id, rank, chunk_id, bm25, keyword_score: each query's k best chunks, of the scope if there is one. queries: query_id, text."""
        out = None
        if self.store.table("chunks") is not None:
            asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), X.query_terms(F.col("text")).alias("terms")).where(F.size("terms") > 0)
            for block in blocks_of(asked, "query_id"):
                found = self._scored([(r["query_id"], r["terms"]) for r in block], k, scope)
                out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], "query_id bigint, rank int, chunk_id string, bm25 double, keyword_score double")
        # k a query, and what ties with the last of them: these alone get their names, by which ties are settled
        best = out.withColumn("at", F.rank().over(Window.partitionBy("query_id").orderBy(F.desc(F.round("bm25", 9))))).where(F.col("at") <= k).drop("at")
        named = best.join(self.store.table("chunks").select("segment", "number", "chunk_id"), ["segment", "number"])
        return top_k(named, k, "bm25").select("query_id", "rank", "chunk_id", "bm25", (1 / (1 + F.abs("bm25"))).alias("keyword_score"))

    def _scored(self, block: list[tuple[int, list[str]]], k: int, scope: Scope | None) -> DataFrame:
        """query_id, segment, number, bm25 of every task's k best chunks a query, for at most search.BLOCK queries."""
        terms = sorted({t for _, own in block for t in own})
        known = self.spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())})).withColumn("bucket", bucket_of(F.col("term"), self.buckets))
        rows = self._asked_blocks(known)
        if self.store.table("gone") is not None:
            rows = stored(self._flat(rows).groupBy("term", *SCOPES, "segment", "block").agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("number", "tf", "dl")).alias("entries")), "kw-living")
        df = {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # at most these queries' terms
        n, avgdl = self.size()
        ids, place, pairs = [q for q, _ in block], {t: i for i, t in enumerate(terms)}, []
        for j, (_, own) in enumerate(block):
            pairs += [(place[t], j, max(FLOOR, float(np.log((n - df[t] + 0.5) / (df[t] + 0.5))))) for t in own if t in df]
        pairs.sort()
        of, query, idf = (np.array([p[i] for p in pairs], kind) for i, kind in enumerate((np.int64, np.int64, np.float64)))
        sent = self.spark.sparkContext.broadcast((terms, np.searchsorted(of, np.arange(len(terms) + 1)), query, idf, ids, avgdl))
        if scope is not None:
            rows = rows.where((F.col("workspace_id") == scope.workspace_id) & F.col("knowledge_base_id").isin(*scope.knowledge_base_ids))
        entries = F.col("entries")
        if scope is not None and scope.document_ids:
            flat = rows.select("term", "segment", "block", F.explode("entries").alias("e")).select("term", "segment", "block", "e.*")
            flat = flat.join(self.store.table("chunks").where(F.col("doc_id").isin(*scope.document_ids)).select("segment", "number"), ["segment", "number"], "left_semi")
            rows = flat.groupBy("term", "segment", "block").agg(F.max("tf").alias("most_tf"), F.min("dl").alias("least_dl"), F.collect_list(F.struct("number", "tf", "dl")).alias("entries"))
        rows = rows.select("segment", "block", "term", "most_tf", "least_dl", entries["number"].alias("numbers"), entries["tf"].alias("tfs"), entries["dl"].alias("dls"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(len(sent.value[4]), k)
            held: list[pa.RecordBatch] = []
            last = None
            for batch in batches:
                if not batch.num_rows:
                    continue
                segment, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                cuts = np.flatnonzero((segment[1:] != segment[:-1]) | (number[1:] != number[:-1])) + 1
                for a, b in pairwise([0, *cuts.tolist(), batch.num_rows]):
                    key = int(segment[a]), int(number[a])
                    if held and key != last:
                        scored_block(best, last[0], pa.Table.from_batches(held), *sent.value[:4], sent.value[5])
                        held = []
                    held.append(batch.slice(a, b - a))
                    last = key
            if held:
                scored_block(best, last[0], pa.Table.from_batches(held), *sent.value[:4], sent.value[5])
            yield best.batch(sent.value[4])

        dealt = rows.repartition("segment", "block").sortWithinPartitions("segment", "block")
        return dealt.mapInArrow(run, "query_id bigint, segment int, number bigint, bm25 double")

    def grep(self, terms: DataFrame) -> DataFrame:
        """query_id, term, chunk_id of every chunk that holds a term (query_id, term) as a token; reads the partitions of those terms."""
        wanted = terms.select("query_id", "term", bucket_of(F.col("term"), self.buckets).alias("bucket"))
        flat = self._flat(self._asked_blocks(wanted.select("term", "bucket").distinct()))
        found = flat.select("term", "segment", "number").join(wanted.drop("bucket"), "term")
        return found.join(self.store.table("chunks").select("segment", "number", "chunk_id"), ["segment", "number"]).select("query_id", "term", "chunk_id")
