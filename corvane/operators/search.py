"""Retrieval: keyword search over postings, token overlap without an index, and exact nearest neighbours.

Keyword scoring joins postings with query terms, and only terms that some query asks for ever leave the scan: the semi-join with
the distinct query terms stands below the first aggregation. Scores aggregate by (query, chunk) before the top-k window.
Nearest neighbours and token overlap score blocks of queries (a fixed number at a time) against every row where it lies, and a
task passes on its own k best a query, so nothing grows with queries times rows but the work itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.storage import stored

K1, B, FLOOR = 1.2, 0.75, 1e-6
#: Queries that are held in memory at once.
BLOCK = 2048
#: Queries of one weight matrix.
PART = 256


def tokenized(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """chunk_id, dl, tokens: each text is cut once. What explodes the tokens must do so in a later select, or their number is worked out anew for every one of them."""
    tokens = X.index_tokens(chunks[text_col])
    return chunks.select(chunks[id_col].alias("chunk_id"), F.size(tokens).alias("dl"), tokens.alias("tokens"))


def postings(chunks: DataFrame, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """term, chunk_id, tf, dl: the inverted index, to be written once and read by term."""
    rows = tokenized(chunks, id_col, text_col).select("chunk_id", "dl", F.explode("tokens").alias("term"))
    return rows.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf"))


def corpus_stats(chunks: DataFrame, text_col: str = "content") -> DataFrame:
    """One row: n_chunks and avgdl."""
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.avg(F.size(X.index_tokens(chunks[text_col]))).alias("avgdl"))


def query_terms(queries: DataFrame, id_col: str = "query_id", text_col: str = "text") -> DataFrame:
    return queries.select(queries[id_col].alias("query_id"), F.explode(X.query_terms(queries[text_col])).alias("term"))


def bm25_scores(chunks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, chunk_id, bm25 of every chunk that holds a term of the query (any term)."""
    wanted = query_terms(queries)
    terms = wanted.select("term").distinct()
    hits = tokenized(chunks).select("chunk_id", "dl", F.explode("tokens").alias("term")).join(terms, "term", "left_semi")
    # read twice, for document frequencies and for scores
    tf = stored(hits.groupBy("term", "chunk_id", "dl").agg(F.count(F.lit(1)).alias("tf")), "query-postings")
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = corpus_stats(chunks).first()  # two numbers
    n, avgdl = float(stats["n_chunks"]), float(stats["avgdl"] or 1.0) or 1.0
    idf = F.greatest(F.lit(FLOOR), F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    asked = wanted.join(df.select("term", idf.alias("idf")), "term")
    part = F.col("idf") * (F.col("tf") * (K1 + 1)) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(avgdl)))
    return asked.join(tf, "term").groupBy("query_id", "chunk_id").agg(F.sum(part).alias("bm25"))


def top_k(scored: DataFrame, k: int, score: str, tie: str = "chunk_id", key: str = "query_id", digits: int = 9) -> DataFrame:
    """The k best rows a key, with rank from 1; scores are compared to `digits` places, ties go by `tie`."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, digits)), tie)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, bm25, keyword_score = 1 / (1 + |bm25|): each query's k best chunks.

    Document frequencies of the queried terms are one small aggregation. Then blocks of queries, as matrices of term weights, meet
    the chunks where they lie: a task looks its tokens up by column, multiplies, and passes on its own k best a query, so pairs of
    queries and chunks are never shuffled.
    """
    import pyarrow.compute as pc

    spark, out = chunks.sparkSession, None
    rows = tokenized(chunks)
    asked = queries.select(queries["query_id"].cast("bigint").alias("query_id"), X.query_terms(queries["text"]).alias("terms")).where(F.size("terms") > 0)
    total = None
    for block in blocks_of(asked, "query_id"):
        terms = sorted({t for r in block for t in r["terms"]})
        known = spark.createDataFrame(pa.table({"term": pa.array(terms, pa.string())}))
        held = rows.select(F.explode(F.array_distinct("tokens")).alias("term")).join(F.broadcast(known), "term")  # at most BLOCK queries' terms
        df = {r["term"]: r["df"] for r in held.groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
        total = total or rows.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl")).first()
        n, avgdl = float(total["n"]), float(total["avgdl"] or 1.0) or 1.0
        idf = {t: max(FLOOR, float(np.log((n - d + 0.5) / (d + 0.5)))) for t, d in df.items()}
        parts = []
        for at in range(0, len(block), PART):
            own = block[at : at + PART]
            names = sorted({t for r in own for t in r["terms"] if t in idf})
            place, weights = {t: i for i, t in enumerate(names)}, np.zeros((len(names), len(own)))
            for j, r in enumerate(own):
                for t in r["terms"]:
                    if t in place:
                        weights[place[t], j] = idf[t]
            parts.append((np.array([r["query_id"] for r in own]), pa.array(names, pa.string()), weights))
        sent = spark.sparkContext.broadcast((parts, avgdl))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            parts, avgdl = sent.value
            best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, 2048):
                    part = batch.slice(start, 2048)
                    ids, dl = np.array(part.column(0).to_pylist(), object), part.column(1).to_numpy(zero_copy_only=False)
                    tokens = part.column(2)
                    flat, of = tokens.flatten(), np.repeat(np.arange(part.num_rows), pc.list_value_length(tokens).to_numpy(zero_copy_only=False))
                    for queries, names, weights in parts:
                        spot = pc.fill_null(pc.index_in(flat, value_set=names), -1).to_numpy(zero_copy_only=False)
                        seen, tf = np.unique((of * len(names) + spot)[spot >= 0], return_counts=True)
                        if not len(seen):
                            continue
                        row, term = seen // len(names), seen % len(names)
                        worth = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl[row] / avgdl))
                        first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                        scores = np.round(np.add.reduceat(weights[term] * worth[:, None], first, axis=0), 9)
                        chunk = ids[row[first]]
                        for j, q in enumerate(queries.tolist()):
                            s = scores[:, j]
                            good = np.flatnonzero(s > 0)
                            if len(good) > k:
                                edge = np.partition(s[good], len(good) - k)[len(good) - k]
                                good = good[s[good] >= edge]
                            if len(good):
                                old = best.get(q)
                                names_, values = (chunk[good], s[good]) if old is None else (np.concatenate([old[0], chunk[good]]), np.concatenate([old[1], s[good]]))
                                order = sorted(range(len(values)), key=lambda i: (-values[i], names_[i]))[:k] if len(values) > k else range(len(values))
                                best[q] = names_[list(order)], values[list(order)]
            flat_rows = [(q, c, v) for q, (cs, vs) in best.items() for c, v in zip(cs.tolist(), vs.tolist(), strict=True)]
            kinds = (pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat_rows], t) for i, t in enumerate(kinds)], ["query_id", "chunk_id", "bm25"])

        found = rows.mapInArrow(run, "query_id bigint, chunk_id string, bm25 double")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, chunk_id string, bm25 double, keyword_score double")
    return top_k(out, k, "bm25").select("query_id", "rank", "chunk_id", "bm25", (1 / (1 + F.abs("bm25"))).alias("keyword_score"))


def blocks_of(queries: DataFrame, key: str) -> Iterator[list]:
    """Queries in the order of their key, a fixed number at a time."""
    last = None
    while rows := (queries if last is None else queries.where(F.col(key) > last)).orderBy(key).limit(BLOCK).collect():
        last = rows[-1][key]
        yield rows


def _best(rows: DataFrame, score: Callable, queries: DataFrame, key: str, k: int, tie_type: str) -> DataFrame:
    """Scores blocks of queries with `score`, a function of (queries of a block, batch) that yields (query, tie, value)."""
    out = None
    for block in blocks_of(queries, key):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            held: dict[int, list[tuple[float, object]]] = {}
            for q, tie, value in score(block, batches):
                own = held.setdefault(q, [])
                own.append((-value, tie))
                if len(own) > 64 + 4 * k:
                    own.sort()
                    del own[k:]
            flat = [(q, t, -v) for q, own in held.items() for v, t in sorted(own)[:k]]
            kinds = (pa.int64(), pa.string() if tie_type == "string" else pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], ["query_id", "tie", "score"])

        part = rows.mapInArrow(run, f"query_id bigint, tie {tie_type}, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], f"query_id bigint, rank int, tie {tie_type}, score double")
    return top_k(out, k, "score", "tie", digits=12).select("query_id", "rank", "tie", "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", by: str | None = None) -> DataFrame:
    """query_id, rank, id, score: the k rows with the highest cosine, to 12 places, a query; its own row is no candidate.

    With `by`, only rows that agree with the query there. queries: query_id, vector (and by). A query meets vectors of its own
    length; null vectors and those of length zero take no part.
    """
    plain = lambda df, i, v: df.select(df[i].cast("bigint").alias("id"), df[v].cast("array<double>").alias("v"), (df[by].cast("string") if by else F.lit("")).alias("g")).where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    asked = plain(queries, "query_id", "vector").withColumnRenamed("id", "query_id")

    def score(block: list, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, float]]:
        asked_by: dict[int, list] = {}  # queries meet vectors of their own length
        for r in block:
            asked_by.setdefault(len(r["v"]), []).append(r)
        sides = {}
        for size, own in asked_by.items():
            q = np.array([r["v"] for r in own], float)
            sides[size] = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300), np.array([r["query_id"] for r in own]), np.array([r["g"] for r in own])
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                met: dict[int, list] = {}
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 4096).columns), strict=True):
                    if len(row[1]) in sides:
                        met.setdefault(len(row[1]), []).append(row)
                for size, rows in met.items():
                    q, ids, groups = sides[size]
                    m = np.array([r[1] for r in rows], float)
                    norm = np.linalg.norm(m, axis=1)
                    good = norm > 0
                    m, names, own_g = m[good] / norm[good, None], np.array([r[0] for r in rows])[good], np.array([r[2] for r in rows])[good]
                    s = np.round(q @ m.T, 12)
                    s[(ids[:, None] == names[None, :]) | (groups[:, None] != own_g[None, :])] = -np.inf
                    for i in range(len(ids)):
                        few = np.argpartition(-s[i], min(k, len(names) - 1))[: k + 1] if len(names) > k + 1 else np.arange(len(names))
                        edge = np.sort(s[i][few])[-k] if len(few) >= k else -np.inf
                        for j in np.flatnonzero((s[i] >= edge) & (s[i] > -np.inf)).tolist():
                            yield int(ids[i]), int(names[j]), float(s[i][j])

    return _best(plain(vectors, id_col, vector_col), score, asked, "query_id", k, "bigint").withColumnRenamed("tie", id_col)


def overlap_search(chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, chunk_id, score: share of the query's tokens that occur anywhere in the chunk's lower-case text, if any do.

    One pass over a chunk finds the tokens of all queries of a block (Aho-Corasick); the queries' counts of a run of chunks are one sum over
    (chunk, token, query), and a task holds its own k best a query.
    """
    asked = queries.select(queries["query_id"].cast("bigint").alias("query_id"), X.overlap_tokens(queries["text"]).alias("tokens")).where(F.size("tokens") > 0)
    rows, out = chunks.select("chunk_id", F.lower("content").alias("text")), None
    for block in blocks_of(asked, "query_id"):

        def run(batches: Iterator[pa.RecordBatch], block: list = block) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            place: dict[str, int] = {}
            pairs = sorted((place.setdefault(t, len(place)), j) for j, r in enumerate(block) for t in r["tokens"])
            machine = ahocorasick.Automaton()
            for t, i in place.items():
                machine.add_word(t, i)
            machine.make_automaton()
            token, query = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
            begins, sizes = np.searchsorted(token, np.arange(len(place) + 1)), np.array([len(r["tokens"]) for r in block])
            least = np.zeros(len(block))
            held: dict[int, list[tuple[float, str]]] = {}
            for batch in batches:
                for start in range(0, batch.num_rows, 512):
                    part = batch.slice(start, 512)
                    found = [list({i for _, i in machine.iter(t)}) if t else [] for t in part.column(1).to_pylist()]
                    hit = np.fromiter((i for own in found for i in own), np.int64)
                    row = np.repeat(np.arange(len(found)), [len(own) for own in found])
                    asks = begins[hit + 1] - begins[hit]
                    who = query[np.arange(asks.sum()) - np.repeat(np.cumsum(asks) - asks, asks) + np.repeat(begins[hit], asks)]
                    counts = np.bincount(np.repeat(row, asks) * len(block) + who, minlength=len(found) * len(block)).reshape(len(found), -1)
                    scores = np.round(counts / sizes, 12)
                    good = (scores > 0) & (scores >= least)
                    names = part.column(0).to_pylist() if good.any() else []
                    for q in np.flatnonzero(good.any(axis=0)).tolist():
                        at = np.flatnonzero(good[:, q])
                        own = sorted([*held.get(q, []), *zip((-scores[at, q]).tolist(), (names[i] for i in at.tolist()))])[:k]
                        held[q] = own
                        if len(own) == k:
                            least[q] = -own[-1][0]
            flat = [(block[q]["query_id"], chunk, -score) for q, own in held.items() for score, chunk in own]
            kinds = (pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in flat], t) for i, t in enumerate(kinds)], ["query_id", "chunk_id", "score"])

        part = rows.mapInArrow(run, "query_id bigint, chunk_id string, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return chunks.sparkSession.createDataFrame([], "query_id bigint, rank int, chunk_id string, score double")
    return top_k(out, k, "score", digits=12).select("query_id", "rank", "chunk_id", "score")


def relevant(hits: DataFrame, least: float = 0.30, distance: str = "distance") -> DataFrame:
    """Hits whose relevance 1 - distance reaches `least`; applied to a query's top-k, never below it."""
    return hits.withColumn("relevance", F.greatest(F.lit(0.0), 1 - F.col(distance))).where(F.col("relevance") >= least)


def direct_load(chunks: DataFrame, kinds: tuple[str, ...], most: int = 50, key: str = "selection") -> DataFrame:
    """All chunks of a selection (key) that has between one and `most` eligible ones, scored down from 1 by their order."""
    w = Window.partitionBy(key)
    rows = chunks.where(F.col("chunk_type").isin(*kinds)).withColumn("n", F.count(F.lit(1)).over(w)).where(F.col("n") <= most)
    rank = F.row_number().over(w.orderBy("doc_id", "seq"))
    return rows.withColumn("rank", rank).withColumn("score", F.greatest(F.lit(0.0), 1 - 0.001 * (F.col("rank") - 1))).drop("n")


def rerank(hits: DataFrame, scorer: Callable[[Column, Column], Column], n: int) -> DataFrame:
    """The n best of each query by a scorer of (question, content)."""
    return top_k(hits.withColumn("reranker_score", scorer(F.col("question"), F.col("content"))), n, "reranker_score").withColumnRenamed("rank", "rerank")


def lexical_scorer(question: Column, content: Column) -> Column:
    """The default scorer: the share of the question's distinct tokens that are tokens of the content."""
    q = X.query_terms(question)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, X.index_tokens(content))) / F.size(q)).otherwise(0.0)
