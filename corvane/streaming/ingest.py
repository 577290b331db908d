"""The ingest loop: files that arrive in a folder become documents, chunks and postings, a versioned commit a micro-batch.

A file stream lists what is new; `publish` reads a batch's files in Arrow batches, sets aside what can't be read, cuts the
rest into chunks, writes a segment of the keyword index, and commits documents, chunks, postings and quarantine together. The batch's
name is part of the commit. A batch that was killed before its commit left only folders that nothing names; when the stream delivers it
again it is published as if for the first time. A batch that was killed after its commit is known by its name and changes nothing.

A path that arrives again replaces its document, also where it can no longer be read: then the document goes and the quarantine tells why.
Of one path twice in a batch the later modification counts. Nothing is gathered on the driver but counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import chunking
from corvane.operators.keyword_index import SCOPES, KeywordIndex
from corvane.sources import files as readers
from corvane.storage import Versioned, stored

#: What Spark's binary file source gives. Small files by the million are better kept as rows of this schema in Parquet.
ARRIVAL = "path string, modificationTime timestamp, length bigint, content binary"
EMPTY, UNSUPPORTED = "empty document", "unsupported type"


def document_id(path: Column) -> Column:
    return F.left(F.sha2(path, 256), F.lit(32))


class Library:
    """Tables documents, chunks, quarantine and the keyword index of a Versioned store.

    base_of says to which knowledge base a path belongs; by default the folder that holds it. more has readers by extension, bytes to
    text. chunker cuts rows with a text column into rows with seq, chunk_id and content.
    """

    def __init__(self, store: Versioned, workspace: str = "w0", base_of: Callable[[Column], Column] | None = None, more: dict[str, Callable[[bytes], str]] | None = None, chunker: Callable[[DataFrame], DataFrame] | None = None) -> None:
        self.store, self.workspace, self.more = store, workspace, more
        self.base_of = base_of or (lambda path: F.element_at(F.split(path, "/"), -2))
        self.chunker = chunker or (lambda rows: chunking.fixed_chunks(rows, id_col="doc_id"))
        self.index = KeywordIndex(store)

    def publish(self, arrived: DataFrame, batch: str) -> dict:
        """Commits a batch of files (ARRIVAL) under its name and returns its counts; a name that is committed already changes nothing."""
        if (note := self.store.done(batch)) is not None:
            return note
        latest = Window.partitionBy("path").orderBy(F.desc("modificationTime"), F.desc("length"))
        rows = arrived.where(readers.is_source(F.col("path"))).withColumn("place", F.row_number().over(latest)).where("place = 1")
        rows = rows.withColumn("ext", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
        read = readers.load(rows, self.more)
        fault = F.when(~F.col("ext").isin(*readers.EXTENSIONS), F.lit(UNSUPPORTED)).when(F.col("error").isNotNull(), F.col("error")).when(X.collapse(F.col("text")) == "", F.lit(EMPTY))
        # what texts tell is kept beside them: they are read again for the chunks alone
        read = stored(read.select(F.lit(self.workspace).alias("workspace_id"), F.coalesce(self.base_of(F.col("path")), F.lit("")).alias("knowledge_base_id"), document_id(F.col("path")).alias("doc_id"), "path", "ext", "text", fault.alias("reason"), F.length("text").alias("n_chars")), "ingest-read")
        number = self.store.version + 1
        good = read.where("reason IS NULL")
        segment = self.index.segment(self.chunker(good.select(*SCOPES, "doc_id", "text")), read.select("doc_id"))
        counts = self.store.part(segment["chunks"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"))
        name = F.element_at(F.split("path", "/"), -1)
        documents = good.drop("text").join(counts, "doc_id", "left").select(*SCOPES, "doc_id", name.alias("name"), F.col("path").alias("storage_path"), F.col("ext").alias("file_type"), F.lit("indexed").alias("parse_status"), "n_chars", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.lit(batch).alias("batch"), F.lit(number).alias("version"))
        documents = self.store.write(documents, "documents")
        bad = self.store.write(read.where("reason IS NOT NULL").select(*SCOPES, "doc_id", F.col("path").alias("storage_path"), "reason", F.lit(batch).alias("batch"), F.lit(number).alias("version")), "quarantine")
        done = self.store.part(documents).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks")).first()
        note = {"documents": done["documents"], "chunks": done["chunks"], "quarantined": self.store.part(bad).count()}
        self.store.commit({"documents": documents, "quarantine": bad, **segment}, batch, note)
        return note

    def ingest(self, source: str, checkpoint: str, form: str = "binaryFile", files_a_batch: int = 1000) -> dict:
        """Publishes all files below `source` that `checkpoint` has not seen, and ends. Returns the counts of all batches so far.

        form is binaryFile, or parquet where `source` holds rows of ARRIVAL.
        """
        stream = self.store.spark.readStream.format(form).schema(ARRIVAL).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_a_batch).load(source)
        name = checkpoint.rstrip("/").rsplit("/", 1)[-1]
        query = stream.writeStream.foreachBatch(lambda rows, number: self.publish(rows, f"{name}-{number}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return self.counts()

    def counts(self) -> dict:
        notes = self.store.state["done"].values()
        return {k: sum(n.get(k, 0) for n in notes) for k in ("documents", "chunks", "quarantined")}

    def documents(self) -> DataFrame:
        return self.index.living(self.store.table("documents"), "version")

    def chunks(self) -> DataFrame:
        return self.index.chunks()

    def quarantine(self) -> DataFrame:
        """Paths that can't be read now, with the reason."""
        return self.index.living(self.store.table("quarantine"), "version")

    def compact(self) -> None:
        """Rewrites all tables without what is gone, as one version."""
        tables = {"documents": self.store.write(self.documents(), "documents"), "quarantine": self.store.write(self.quarantine(), "quarantine")}
        self.store.commit(tables | self.index.merged(), replace=(*tables, "chunks", "blocks", "sizes", "gone"))

    def reset(self, base: str) -> None:
        """Takes all documents of a knowledge base out, as before a full rebuild of it."""
        rows = self.documents().where(F.col("knowledge_base_id") == base).select("doc_id").unionByName(self.quarantine().where(F.col("knowledge_base_id") == base).select("doc_id"))
        self.index.delete(rows)
