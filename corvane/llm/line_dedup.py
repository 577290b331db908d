"""Line deduplication against levelled sorted runs of line hashes (DataFrame and SQL functions only).

The index is a folder of runs: Parquet tables of (hash, owner), bucketed and sorted by hash, no hash in two of them. A batch
of documents is first cut into thin line rows; its hashes, aggregated to one row each with the smallest id that holds it, are
merge-anti-joined with every run, which needs no shuffle of the runs. What remains is new and becomes a run of level 0. Before a batch,
a level that holds `fanout` runs is merged into one run of the next level, so a batch meets at most (fanout x levels) runs and a hash is rewritten once a
level. A line of the batch stays only where its own document owns the hash in the batch's new run.

`drop_lines` folds a whole table, in batches of ascending ids, so that the smallest id is the one that keeps a line.

Shape of the plan: lines travel as (hash of 16 bytes, id, row, place), never as text. Lines meet owners on (hash, id), so a line that
a third of all documents hold is spread by id; its hash is aggregated before the first shuffle. The texts move once, to meet the places of
their dropped lines; a document's places are no more than its lines.

Each batch is committed by one renamed manifest file, after its run and its dropped lines are written; a repeated batch name returns
what was written then. A driver that starts again on the folder goes on from the last manifest.

Defined results
* null and empty texts are one empty line. A key is a line without blanks at both ends, A-Z in lower case; keys under ten code points are left alone.
* a null id is larger than all others, and all rows without id are one document.
* repeated rows, and rows that share an id, are one document: they keep or lose a line together, and each returns.
* a line that one document repeats stays in it, all its places, if the document is its owner.
* very long texts are handled whole. An empty table gives an empty result. Other columns, whatever their names, are handed through.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from corvane.llm._common import ascii_lower, scratch_path, table, unused, whole

BLANKS = " \t\n\x0b\x0c\r"
#: Keys with fewer code points are never dropped.
LEAST = 10
FANOUT, BATCHES = 2, 4
#: A bucket of a run is one file in the order of its hashes; with this setting Spark relies on that order and does not sort again.
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def key_of(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def thin_lines(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST) -> DataFrame:
    """(id, row, place, hash) of every line whose key is long enough; row tells apart texts that share an id."""
    text = whole(docs, text_col)
    each = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("row"), F.posexplode(lines_of(text)).alias("place", "line"))
    each = each.select("id", "row", "place", key_of(F.col("line")).alias("key")).where(F.length("key") >= least)
    return each.select("id", "row", "place", F.substring(F.unhex(F.sha2(F.col("key"), 256)), 1, 16).alias("hash"))


class LineIndex:
    """Levelled runs in `folder`, which every executor must see. Batches must come one after the other."""

    def __init__(self, spark: SparkSession, folder: str, id_type: DataType, buckets: int | None = None, fanout: int = FANOUT) -> None:
        self.spark, self.folder, self.id_type, self.fanout = spark, folder, id_type.simpleString(), fanout
        self.names: dict[str, str] = {}
        at = self._at(folder)
        self.files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(at)
        versions = sorted(int(s.getPath().getName()[9:]) for s in self.files.listStatus(at) if s.getPath().getName().startswith("manifest-"))
        self.version = versions[-1] if versions else 0
        self.state = json.loads(spark.read.text(f"{folder}/manifest-{self.version}", wholetext=True).first()[0]) if versions else {"buckets": buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), "runs": [], "batches": {}}

    def _at(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _commit(self, runs: list, batches: dict) -> None:
        """The next manifest appears whole, by a rename, or not at all."""
        state = self.state | {"runs": runs, "batches": batches}
        new = self._at(f"{self.folder}/new-{uuid.uuid4().hex}")
        out = self.files.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if not self.files.rename(new, self._at(f"{self.folder}/manifest-{self.version + 1}")):
            raise RuntimeError("another writer has committed to this index")
        self.version, self.state = self.version + 1, state

    def _run(self, name: str) -> DataFrame:
        """The run's table, declared to this session where it is not yet."""
        if name not in self.names:
            self.names[name] = f"corvane_run_{uuid.uuid4().hex}"
            self.spark.sql(f"CREATE TABLE {self.names[name]} (hash BINARY, owner {self.id_type}) USING parquet CLUSTERED BY (hash) SORTED BY (hash) INTO {self.state['buckets']} BUCKETS LOCATION '{self.folder}/{name}'")
        return self.spark.table(self.names[name])

    def _written(self, rows: DataFrame) -> str:
        name = f"run-{uuid.uuid4().hex}"
        self._run(name)
        # dealt as buckets are, so that each bucket is one file; the writer sorts it
        rows.select("hash", "owner").repartition(self.state["buckets"], "hash").write.insertInto(self.names[name])
        self.spark.catalog.refreshTable(self.names[name])
        return name

    def compact(self) -> None:
        """Merges the runs of each full level into one of the next."""
        level = 0
        while any(at >= level for at, _ in self.state["runs"]):
            full = [name for at, name in self.state["runs"] if at == level]
            if len(full) >= self.fanout:
                rows = self._run(full[0])
                for name in full[1:]:
                    rows = rows.unionByName(self._run(name))
                merged = self._written(rows)
                self._commit([r for r in self.state["runs"] if r[1] not in full] + [[level + 1, merged]], self.state["batches"])
                for name in full:
                    self._forget(name)
                    self.files.delete(self._at(f"{self.folder}/{name}"), True)
            level += 1

    def add(self, lines: DataFrame, batch: str) -> DataFrame:
        """lines (id, row, place, hash) of a batch -> those to drop: id, row, place."""
        dropped = self.state["batches"].get(batch)
        if dropped is None:
            held = self.spark.conf.get(ORDERED, None)
            self.spark.conf.set(ORDERED, "true")
            try:
                self.compact()
                new = lines.groupBy("hash").agg(F.min("id").alias("owner"))
                for _, name in self.state["runs"]:
                    new = new.join(self._run(name).select("hash").hint("merge"), "hash", "left_anti")
                run = self._written(new)
                own = self._run(run).withColumnRenamed("hash", "owned")
                dropped = f"dropped-{uuid.uuid4().hex}"
                lines.join(own, (lines["hash"] == own["owned"]) & lines["id"].eqNullSafe(own["owner"]), "left_anti").select("id", "row", "place").write.parquet(f"{self.folder}/{dropped}")
                self._commit([*self.state["runs"], [0, run]], self.state["batches"] | {batch: dropped})
            finally:
                self.spark.conf.set(ORDERED, held) if held is not None else self.spark.conf.unset(ORDERED)
        return self.spark.read.schema(f"id {self.id_type}, row bigint, place int").parquet(f"{self.folder}/{dropped}")

    def _forget(self, name: str) -> None:
        if name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.names.pop(name)}")

    def close(self) -> None:
        """Takes the runs' names from the session's catalogue; the folder stays."""
        for name in list(self.names):
            self._forget(name)


def batch_bounds(docs: DataFrame, id_col: str, batches: int) -> list:
    """The first ids of all batches but the first, for about equal batches. Where they lie decides no result."""
    ids = docs.where(docs[id_col].isNotNull()).select(docs[id_col].alias("id")).repartitionByRange(batches, "id")
    firsts = sorted(r["first"] for r in ids.groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("first")).collect())
    # the session may deal into more parts than were asked for
    return sorted({firsts[len(firsts) * i // batches] for i in range(1, batches)} - {firsts[0]}) if firsts else []


def without(docs: DataFrame, dropped: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with text_col cut, plus n_lines and n_dropped (under free names): (frame, name of n_lines, name of n_dropped)."""
    gone = dropped.groupBy(F.col("id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("place")).alias("_gone"))
    text = whole(docs, text_col)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_doc"), docs[id_col].alias("_at"), text.alias("_text"))
    rows = rows.join(gone.hint("shuffle_hash"), F.col("_at").eqNullSafe(F.col("_id")) & (F.xxhash64("_text") == F.col("_row")), "left")
    # the stretches between dropped places are joined, so that the work grows with the lines and not with lines x dropped lines
    lines, cuts = F.col("_lines"), F.col("_cuts")
    stretch = lambda i: F.slice(lines, F.get(cuts, i) + 2, F.get(cuts, i + 1) - F.get(cuts, i) - 1)
    rows = rows.withColumn("_lines", lines_of(F.col("_text"))).withColumn("_cuts", F.concat(F.array(F.lit(-1)), F.coalesce("_gone", F.array().cast("array<int>")), F.array(F.size("_lines"))))
    kept = F.when(F.col("_gone").isNull(), F.col("_text")).otherwise(F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), stretch)), "\n"))
    n_lines, n_dropped = unused(docs, "n_lines"), unused(docs, "n_dropped")
    columns = [kept.alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns]
    return rows.select(*columns, F.size("_lines").cast("long").alias(n_lines), (F.size(cuts) - 2).cast("long").alias(n_dropped))


def drop_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES, fanout: int = FANOUT, least: int = LEAST) -> DataFrame:
    """docs, all columns, without the lines that a document of smaller id holds, plus n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    bounds = batch_bounds(docs, id_col, batches)
    lines = thin_lines(docs, id_col, text_col, least)
    number = sum((F.when(F.col("id") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    arrived = scratch_path(spark, "lines")
    lines.withColumn("batch", F.when(F.col("id").isNull(), len(bounds)).otherwise(number)).write.partitionBy("batch").parquet(arrived)
    lines = spark.read.schema(lines.withColumn("batch", F.lit(0)).schema).parquet(arrived)
    index = LineIndex(spark, scratch_path(spark, "line-runs"), docs.schema[id_col].dataType, fanout=fanout)
    dropped = None
    for b in range(len(bounds) + 1):
        now = index.add(lines.where(F.col("batch") == b).drop("batch"), f"batch-{b}")
        dropped = now if dropped is None else dropped.unionByName(now)
    index.close()
    return without(docs, dropped, id_col, text_col)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH l AS (SELECT doc_id, place, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
o AS (SELECT key, min(doc_id) AS owner FROM l WHERE length(key) >= 10 GROUP BY key),
k AS (SELECT doc_id, place, line, coalesce(doc_id > owner, false) AS gone FROM l LEFT JOIN o USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256 FROM k GROUP BY doc_id
"""
