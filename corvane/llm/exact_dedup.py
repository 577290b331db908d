"""Exact deduplication with keyed streaming state (DataFrame and SQL functions only).

Every text is reduced to (digest, document id, content locator). A Structured Streaming aggregation keeps one state row per
digest in RocksDB, without a watermark, so that state never expires: the number of rows seen, the identifier that stays, and
where its content lies. A digest seen once is unique. Digests seen more often are *hits*: their texts are grouped by digest and
full bytes, so two texts that merely share a digest are told apart.

Shape of the plan: the first pass stores one thin row per document (id, digest, locator) and everything but the byte check
works on those rows. The state aggregates before its shuffle and holds one row per digest however many copies there are. The
byte check is the one place where texts move: they are dealt by digest and a salt, so that a large group is spread, and
aggregated before the second exchange, which then carries one text a group and task. The last join is a plain equi-join whose
hot keys adaptive execution may split.

Defined results
* null text is the empty text; all empty texts are one group.
* a null id sorts below all others, so it stays only if its whole group has no id.
* repeated rows (same id and text) are one document: they count in group_size and share the verdict; `drop_copies` returns one.
* very long texts are hashed and compared whole. Empty tables give empty results.
* other columns, whatever their names, are ignored by `verdicts` and handed through unchanged by `drop_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm._common import ascii_lower, scratch_path, stored, table, whole

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_ROCKS = "spark.sql.streaming.stateStore.rocksdb."
#: RocksDB, and no disk space taken in advance: a state partition then costs what it holds. What its partitions hold in memory
#: outside the heap is bounded for an executor as a whole, however many of them it has; the rest of the state is on disk. A partition
#: that is committed is closed: else each keeps its handles, threads and buffers in its executor long after the query has ended.
STATE = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB, f"{_ROCKS}allowFAllocate": "false", f"{_ROCKS}boundedMemoryUsage": "true", f"{_ROCKS}maxMemoryUsageMB": "128", f"{_ROCKS}writeBufferSizeMB": "4", "spark.sql.streaming.stateStore.unloadOnCommit": "true"}
#: Parts over which the texts of one digest are spread for the byte check.
SALTS = 16


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def keyed_state(arrivals: DataFrame, checkpoint: str) -> DataFrame:
    """Folds a stream of (digest, id, locator) into the state at `checkpoint` and reads that state back: digest, seen, keep, locator.

    Calling it again with the same checkpoint and a grown source folds in the new files only; no key ever expires.
    """
    spark = arrivals.sparkSession
    held = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        # the state's fields bear the aggregates' names
        state = arrivals.groupBy("digest").agg(F.count(F.lit(1)), F.max(F.struct("id", "locator")))
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    kept = spark.read.format("statestore").load(checkpoint)
    return kept.select("key.digest", F.col("value.count").alias("seen"), F.col("value.max.id").alias("keep"), F.col("value.max.locator").alias("locator"))


class Judged:
    """What the passes over `docs` leave in the shared folder.

    thin: id, digest, sha of every row. state: digest, seen, keep. mixed: digests that several texts share, with `texts`, the
    (digest, sha) classes of those; None if there are none.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> None:
        spark = docs.sparkSession
        norm = ascii_lower(whole(docs, text_col))
        rows = docs.select(digest(norm).alias("digest"), sha256(norm).alias("sha"), docs[id_col].alias("id"), F.input_file_name().alias("locator"))
        arrived = scratch_path(spark, "digests")
        rows.write.parquet(arrived)
        self.thin = spark.read.schema(rows.schema).parquet(arrived)
        stream = spark.readStream.schema(rows.schema).parquet(arrived)
        self.state = stored(keyed_state(stream, scratch_path(spark, "state")), "dedup-state")
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        hits = self.state.where("seen > 1").select("digest", salts.alias("salt"))
        texts = docs.select(digest(norm).alias("digest"), F.pmod(F.hash(docs[id_col]), F.lit(SALTS)).alias("salt"), norm.alias("norm"), docs[id_col].alias("id"))
        same = texts.join(hits.hint("shuffle_hash"), ["digest", "salt"], "left_semi").groupBy("digest", "norm").agg(F.max("id").alias("keep"), F.count(F.lit(1)).alias("seen"))
        classes = stored(same.select("digest", sha256(F.col("norm")).alias("sha"), "keep", "seen"), "dedup-classes")
        mixed = classes.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
        self.texts = None if mixed.isEmpty() else classes.join(mixed, "digest", "left_semi")

    def verdict(self, rows: DataFrame) -> DataFrame:
        """rows (with digest and sha) plus keep and seen."""
        state = self.state.select("digest", "keep", "seen")
        if self.texts is None:
            return rows.join(state.hint("shuffle_hash"), "digest")
        # where different texts share a digest, the class is found by the text's own hash as well
        several = self.texts.select("digest", "sha", F.col("keep").alias("own_keep"), F.col("seen").alias("own_seen"), F.lit(True).alias("own"))
        joined = rows.join(state.hint("shuffle_hash"), "digest").join(several, ["digest", "sha"], "left")
        pick = lambda a, b: F.when(F.col("own"), F.col(a)).otherwise(F.col(b)).alias(b)
        return joined.select(*rows.columns, pick("own_keep", "keep"), pick("own_seen", "seen"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256. `digest` may be weak; full bytes decide."""
    judged = Judged(docs, id_col, text_col, digest)
    rows = judged.verdict(judged.thin)
    return rows.select(F.col("id").alias(id_col), F.col("keep").alias("keep_id"), F.col("seen").alias("group_size"), F.col("id").eqNullSafe(F.col("keep")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """docs, all columns, without copies: of equal texts the row with the largest id stays, once."""
    judged = Judged(docs, id_col, text_col, digest)
    norm = ascii_lower(whole(docs, text_col))
    rows = docs.select(digest(norm).alias("digest"), sha256(norm).alias("sha"), docs[id_col].alias("id"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    stay = judged.verdict(rows).where(F.col("id").eqNullSafe(F.col("keep")))
    repeated = judged.thin.groupBy("sha", "id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "id")
    if repeated.isEmpty():
        return stay.select("whole.*")
    again = stay.join(repeated.withColumn("again", F.lit(True)), (stay["sha"] == repeated["sha"]) & stay["id"].eqNullSafe(repeated["id"]), "left").select(stay["sha"], stay["id"], "whole", "again")
    once = again.where(F.col("again").isNull()).select("whole")
    return once.unionByName(again.where("again").dropDuplicates(["sha", "id"]).select("whole")).select("whole.*")


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


OP3_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""
