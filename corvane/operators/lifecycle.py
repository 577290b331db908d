"""Knowledge bases from creation to archive, uploads that may be cancelled under a worker, and the queries made of a question.

Requests come as tables and are judged all at once: each row is answered with a reason, which is empty where the request holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Blanks, and queries made of one question at most.
BLANKS, MAX_QUERIES = " \t\n\r\f\x0b", 5


def stripped(text: Column) -> Column:
    return F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))


def name_key(name: Column) -> Column:
    """Names are the same whatever the case of A to Z."""
    return F.translate(stripped(name), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def judged_creations(requests: DataFrame, bases: DataFrame, workspaces: DataFrame) -> DataFrame:
    """requests (id, workspace_id, name, type, ord) with `reason`.

    A base needs an active workspace, a name, the type document, and a name that no base of its workspace and no earlier valid
    request has. Ties of ord go to the smaller id. bases: workspace_id, name; workspaces: workspace_id, status.
    """
    active = workspaces.where("status = 'active'").select("workspace_id", F.lit(True).alias("active")).distinct()
    taken = bases.select("workspace_id", name_key(F.col("name")).alias("key"), F.lit(True).alias("taken")).distinct()
    rows = requests.withColumn("key", name_key(F.col("name"))).join(active, "workspace_id", "left").join(taken, ["workspace_id", "key"], "left")
    early = F.when(F.col("active").isNull(), "workspace missing or archived").when(F.col("key") == "", "empty name").when(~F.col("type").eqNullSafe("document"), "unsupported type").when(F.col("taken"), "name exists")
    rows = rows.withColumn("early", early)
    first = rows.where("early IS NULL").groupBy("workspace_id", "key").agg(F.min(F.struct("ord", "id")).alias("first"))
    own = rows.join(first, ["workspace_id", "key"], "left")
    late = F.when(F.struct("ord", "id") != F.col("first"), "name exists").otherwise("")
    return own.select(*requests.columns, F.coalesce("early", late).alias("reason"))


def judged_statuses(bases: DataFrame, changes: DataFrame, default_id: object) -> DataFrame:
    """id, action, status, reason of changes (id, action: archive or restore; one a base) to bases (id, status).

    The default base and one that is not active cannot be archived; any base that exists can be restored.
    """
    rows = changes.join(bases.select("id", F.col("status").alias("was")), "id", "left")
    archive = F.col("action") == "archive"
    reason = (
        F.when(archive & (F.col("id") == F.lit(default_id)), "default base")
        .when(F.col("was").isNull() | archive & (F.col("was") != "active"), "not found")
        .when(~F.col("action").isin("archive", "restore"), "unknown action")
        .otherwise("")
    )
    return rows.withColumn("reason", reason).select("id", "action", F.when(F.col("reason") != "", F.col("was")).when(archive, "archived").otherwise("active").alias("status"), "reason")


def with_statuses(bases: DataFrame, judged: DataFrame) -> DataFrame:
    """bases after the changes that hold."""
    new = judged.where("reason = ''").select("id", F.col("status").alias("now"))
    return bases.join(new, "id", "left").withColumn("status", F.coalesce("now", "status")).select(*bases.columns)


def worker_outcomes(tasks: DataFrame, files: DataFrame, batches: DataFrame) -> DataFrame:
    """tasks (task_id, file_id, batch_id) with outcome, message and retry.

    A cancelled file or batch aborts the task; a file that failed fails it and may be tried again. files: file_id, status,
    error_message; batches: batch_id, status. A file or batch that is not there fails the task for good.
    """
    own = files.select("file_id", F.col("status").alias("file_status"), "error_message", F.lit(True).alias("has_file"))
    around = batches.select("batch_id", F.col("status").alias("batch_status"), F.lit(True).alias("has_batch"))
    rows = tasks.join(own, "file_id", "left").join(around, "batch_id", "left")
    missing = F.col("has_file").isNull() | F.col("has_batch").isNull()
    canceled = F.coalesce((F.col("file_status") == "canceled") | (F.col("batch_status") == "canceled"), F.lit(False))
    failed = F.col("file_status").eqNullSafe("failed")
    outcome = F.when(missing, "missing").when(canceled, "canceled").when(failed, "failed").otherwise("completed")
    message = F.when(failed & ~missing & ~canceled, F.coalesce(F.nullif("error_message", F.lit("")), F.lit("Upload file processing failed"))).otherwise("")
    return rows.select(*tasks.columns, outcome.alias("outcome"), message.alias("message"), (outcome == "failed").alias("retry"))


def understood(queries: DataFrame, text_col: str = "text", rewrites_col: str | None = None, most: int = MAX_QUERIES) -> DataFrame:
    """queries with retrieval_queries and understood_by.

    The question comes first, then what a provider rewrote (an array column, null where it gave nothing), stripped, each once, no
    blank ones, `most` in all. A blank question is asked as it stands. understood_by: fallback, or llm where a rewrite was given.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    more = F.coalesce(F.col(rewrites_col) if rewrites_col else F.lit(None), F.array().cast("array<string>"))
    more = F.filter(F.transform(more, stripped), lambda x: x != "")
    blank = stripped(text) == ""
    asked = F.when(blank, F.array(text)).otherwise(F.slice(F.array_distinct(F.concat(F.array(stripped(text)), more)), 1, max(1, most)))
    by = F.when(~blank & (F.size(more) > 0), "llm").otherwise("fallback")
    return queries.select(*queries.columns, asked.alias("retrieval_queries"), by.alias("understood_by"))


def provider_rewrites(output: Column) -> Column:
    """The queries of a rewrite provider's output: a list, or an object with `queries`; null, and anything else, gives none. Entries that are no strings go."""
    said = F.try_parse_json(output)
    found = F.coalesce(F.try_variant_get(said, "$.queries", "array<variant>"), F.try_variant_get(said, "$", "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(F.transform(F.filter(found, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: stripped(F.try_variant_get(v, "$", "string"))), lambda x: x != "")


def provider_intent(output: Column) -> Column:
    """Struct (intent, constraints) of an intent provider's output: the constraints that are objects, as JSON; empty where it can't be read."""
    said = F.try_parse_json(output)
    is_object = F.coalesce(F.schema_of_variant(said).startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<variant>")
    held = F.filter(F.coalesce(F.try_variant_get(said, "$.constraints", "array<variant>"), none), lambda v: F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)))
    intent = F.coalesce(stripped(F.try_variant_get(said, "$.intent", "string")), F.lit(""))
    return F.struct(F.when(is_object, intent).otherwise("").alias("intent"), F.when(is_object, F.transform(held, lambda v: F.to_json(v))).otherwise(F.array().cast("array<string>")).alias("constraints"))


def query_understanding(queries: DataFrame, text_col: str = "text", rewrite_col: str | None = None, intent_col: str | None = None, most: int = MAX_QUERIES) -> DataFrame:
    """queries with retrieval_queries, intent, constraints and source, read from providers' outputs (strings).

    The question comes first, then the rewrites, each once, `most` in all. source is fallback; llm if one provider said something
    that could be read, mixed if both did. A blank question is asked as it stands and nothing is read for it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = stripped(text) == ""
    nothing = F.lit(None).cast("string")
    rows = queries.withColumn("_more", F.when(~blank, provider_rewrites(F.col(rewrite_col) if rewrite_col else nothing)).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_said", F.when(~blank, provider_intent(F.col(intent_col) if intent_col else nothing)).otherwise(provider_intent(nothing)))
    asked = F.when(blank, F.array(text)).otherwise(F.slice(F.array_distinct(F.concat(F.array(stripped(text)), F.col("_more"))), 1, max(1, most)))
    spoke = (F.size("_more") > 0).cast("int") + ((F.col("_said.intent") != "") | (F.size("_said.constraints") > 0)).cast("int")
    source = F.when(spoke == 2, "mixed").when(spoke == 1, "llm").otherwise("fallback")
    return rows.select(*queries.columns, asked.alias("retrieval_queries"), F.col("_said.intent").alias("intent"), F.col("_said.constraints").alias("constraints"), source.alias("source"))
