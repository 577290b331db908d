"""Tables in the folder that the whole cluster shares."""

from __future__ import annotations

import json
import re
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Ends the name of a folder that is partitioned by columns.
PARTED = "-parted"
#: How Spark names the number of files that a task holds open, and their buffers, which are held for all of them at once.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN = {"parquet.block.size": str(1 << 20), "parquet.page.size": str(1 << 16), "parquet.dictionary.page.size": str(1 << 15)}
_homes: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir. Where it is unset, a local session gets one of its own; a cluster must name it."""
    named, context = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(named or "file:///tmp/checkpoints/corvane")
    return (named or context._jsc.sc().getCheckpointDir().get()).rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new place in this application's own folder inside the shared one. That folder goes when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _homes:
        _homes[app] = f"{shared_dir(spark)}/corvane-{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_homes[app])
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{_homes[app]}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once and read back: its lineage ends here, and lost executors lose nothing."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where it comes in fewer parts than there are, as from one small file; larger inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def light_batches(spark: SparkSession, at_most: int = 4 << 20) -> None:
    """Bounds the session's Arrow batches by bytes, where no lower bound is set: ten thousand files at once are more than a worker should hold."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name))
    if not 0 < now <= at_most:
        spark.conf.set(name, str(at_most))


class Versioned:
    """Tables in a shared folder that change together: each is a list of Parquet folders, and a version is one manifest that names them.

    Folders are written first and nobody sees them; `commit` makes them a version by renaming one small file. What a killed writer
    leaves is named by no manifest. A name that was committed once is never committed again, so a repeated batch adds
    nothing. Readers may ask for any version. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, version: int | None = None) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.files = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.files.mkdirs(self._at(""))
        names = (s.getPath().getName() for s in self.files.listStatus(self._at("")))
        there = sorted(int(n.removeprefix("manifest-")) for n in names if n.startswith("manifest-"))
        self.version = version if version is not None else there[-1] if there else 0
        self.state: dict = {"tables": {}, "schemas": {}, "done": {}}
        if self.version:
            self.state = json.loads(spark.read.text(f"{self.root}/manifest-{self.version}", wholetext=True).first()[0])

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def write(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = (), parts: int = 0) -> tuple[str, str]:
        """(folder, schema) of df's rows, as `commit` takes them.

        parts: how many parts `partition_by` has at most. A task then keeps a file of each open, in small row groups, and its rows need not be sorted by part.
        """
        name = f"{table}-{uuid.uuid4().hex}" + PARTED * bool(partition_by)
        out, before = df.write.partitionBy(*partition_by).option("compression", "zstd"), self.spark.conf.get(WRITERS)
        self.spark.conf.set(WRITERS, str(2 * parts) if parts else before)  # short of this number Spark falls back to a sort
        try:
            (out.options(**OPEN) if parts else out).parquet(f"{self.root}/{name}")
        finally:
            self.spark.conf.set(WRITERS, before)
        return name, df.schema.json()

    def part(self, folder: tuple[str, str]) -> DataFrame:
        """What a folder holds, committed or not."""
        return self.spark.read.schema(StructType.fromJson(json.loads(folder[1]))).parquet(f"{self.root}/{folder[0]}")

    def done(self, name: str) -> dict | None:
        """What was noted with the commit of that name, if there was one."""
        return self.state["done"].get(name)

    def commit(self, added: dict[str, tuple[str, str]], name: str | None = None, note: dict | None = None, replace: tuple[str, ...] = ()) -> int:
        """A new version: folders are added to tables, or are all that is left of those named in `replace`."""
        if name is not None and name in self.state["done"]:
            raise ValueError(f"{name} is committed already")
        tables = {t: [] if t in replace else list(paths) for t, paths in self.state["tables"].items()}
        schemas = dict(self.state["schemas"])
        for table, (folder, schema) in added.items():
            tables.setdefault(table, []).append(folder)
            schemas[table] = schema
        state = {"tables": tables, "schemas": schemas, "done": self.state["done"] | ({name: note or {}} if name is not None else {})}
        new, final = self._at(f"new-{uuid.uuid4().hex}"), self._at(f"manifest-{self.version + 1}")
        out = self.files.create(new)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        if self.files.exists(final) or not self.files.rename(new, final):
            raise RuntimeError("another writer has committed meanwhile")
        self.version, self.state = self.version + 1, state
        return self.version

    def table(self, name: str) -> DataFrame | None:
        """The table at this version, or None if it has none yet."""
        folders = self.state["tables"].get(name)
        if not folders:
            return None
        schema = StructType.fromJson(json.loads(self.state["schemas"][name]))
        paths = [f"{self.root}/{f}" for f in folders]
        if not folders[0].endswith(PARTED):
            return self.spark.read.schema(schema).parquet(*paths)
        # Spark takes several partitioned folders for one table only below one base
        return reduce(DataFrame.unionByName, (self.spark.read.schema(schema).parquet(p) for p in paths))
