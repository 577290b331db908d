"""A property graph as a vertex and an edge table: search, bounded traversal, resolution, upserts.

Traversals are loops of at most five equi-joins on the frontier. An edge is used once in a trail. Limits apply after an order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import text as X

MAX_DEPTH = 5


def search_entities(entities: DataFrame, text: str, k: int = 10) -> DataFrame:
    """Entities (id, name, aliases) whose id or name is the text, or whose name or an alias holds it; best first, then by name."""
    q = text.strip().lower()
    held = F.lower("name").contains(q) | F.exists("aliases", lambda a: F.lower(a).contains(q))
    score = F.when(F.lower("id") == q, 1.0).when(F.lower("name") == q, 0.95).when(held, 0.85)
    return entities.withColumn("score", score).where("score IS NOT NULL").orderBy(F.desc("score"), "name", "id").limit(k)


def both_ways(edges: DataFrame) -> DataFrame:
    """(u, v, edge_id) in both directions of edges (edge_id, src, dst)."""
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), "edge_id").union(edges.where("src <> dst").select(F.col("dst"), F.col("src"), "edge_id"))


def trails(edges: DataFrame, seeds: DataFrame, depth: int, stop: DataFrame | None = None) -> DataFrame:
    """seed, node, depth, nodes, edge_ids of all trails of 1..depth edges from each seed (column `node`).

    With `stop` (column `node`), trails are not continued beyond those nodes.
    """
    step = both_ways(edges)
    front = seeds.select(F.col("node").alias("seed"), "node", F.array("node").alias("nodes"), F.array().cast(f"array<{dict(edges.dtypes)['edge_id']}>").alias("edge_ids"))
    out = None
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        front = front.join(step, front["node"] == step["u"]).where(~F.array_contains("edge_ids", F.col("edge_id")))
        front = front.select("seed", F.col("v").alias("node"), F.array_append("nodes", F.col("v")).alias("nodes"), F.array_append("edge_ids", F.col("edge_id")).alias("edge_ids"))
        here = front.withColumn("depth", F.lit(d))
        out = here if out is None else out.unionByName(here)
        if stop is not None:
            front = front.join(stop.select("node").distinct(), "node", "left_anti")
    return out.select("seed", "node", "depth", "nodes", "edge_ids")


def neighbours(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """seed, node, depth: nodes within `depth` of each seed with their least distance. Level by level, each node once a seed."""
    step = both_ways(edges).select("u", "v").distinct()
    front = seeds.select(F.col("node").alias("seed"), "node").distinct()
    seen = front.withColumn("depth", F.lit(0))
    for d in range(1, min(depth, MAX_DEPTH) + 1):
        front = front.join(step, front["node"] == step["u"]).select("seed", F.col("v").alias("node")).distinct().join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(d)))
    out = seen.where("depth > 0")
    if limit:
        out = out.withColumn("rn", F.row_number().over(Window.partitionBy("seed").orderBy("depth", "node"))).where(F.col("rn") <= limit).drop("rn")
    return out


def paths(edges: DataFrame, source: object, target: object, depth: int, limit: int = 10) -> DataFrame:
    """depth, nodes, edge_ids of the trails from source to target, shortest first, then by their edges."""
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["src"]
    seed = spark.range(1).select(F.lit(source).cast(kind).alias("node"))
    return trails(edges, seed, depth).where(F.col("node") == F.lit(target).cast(kind)).select("depth", "nodes", "edge_ids").orderBy("depth", "edge_ids").limit(limit)


def traceable(found: DataFrame, edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Trails all of whose edges have an evidence chunk that exists (edges: edge_id, source_chunk_id; chunks: chunk_id)."""
    good = edges.join(chunks.select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_semi").select("edge_id")
    each = found.withColumn("trail", F.monotonically_increasing_id())
    broken = each.select("trail", F.explode("edge_ids").alias("edge_id")).join(good, "edge_id", "left_anti").select("trail").distinct()
    return each.join(broken, "trail", "left_anti").drop("trail")


def path_text(names: Column) -> Column:
    return F.array_join(names, " ; ")


def normalized_name(name: Column) -> Column:
    return X.normalized(F.regexp_replace(name, r"[\s_\-]+", " "))


def resolve_entities(candidates: DataFrame, entities: DataFrame) -> DataFrame:
    """candidate (type, name) -> entity_id: the known entity of the type with that normalised name or alias (smallest id), else a new id from type and name."""
    known = entities.select("type", "id", F.explode(F.array_distinct(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("n"))
    known = known.groupBy("type", normalized_name(F.col("n")).alias("key")).agg(F.min("id").alias("known"))
    rows = candidates.withColumn("key", normalized_name(F.col("name"))).join(known, ["type", "key"], "left")
    fresh = F.substring(F.sha2(F.concat_ws(":", "type", "key"), 256), 1, 24)
    return rows.withColumn("entity_id", F.coalesce("known", fresh)).withColumn("is_new", F.col("known").isNull()).drop("key", "known")


def resolve_endpoints(relations: DataFrame, local: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with entity ids at both ends, those with an end that no entity bears). Names are looked up in the relation's chunk
    first, then in its document. local: chunk_id, name, entity_id; wide: doc_id, name, entity_id."""
    near = local.groupBy("chunk_id", normalized_name(F.col("name")).alias("key")).agg(F.min("entity_id").alias("near"))
    far = wide.groupBy("doc_id", normalized_name(F.col("name")).alias("key")).agg(F.min("entity_id").alias("far"))
    rows = relations
    for end in ("source", "target"):
        key = normalized_name(F.col(f"{end}_name"))
        rows = rows.withColumn("key", key).join(near, ["chunk_id", "key"], "left").join(far, ["doc_id", "key"], "left")
        rows = rows.withColumn(f"{end}_id", F.coalesce("near", "far")).drop("key", "near", "far")
    ok = F.col("source_id").isNotNull() & F.col("target_id").isNotNull()
    return rows.where(ok), rows.where(~ok)


def valid_relations(relations: DataFrame, chunks: DataFrame, kinds: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(relations of a known kind with an evidence chunk that exists, a document and an extractor version; the others with a reason)."""
    ids = chunks.select(F.col("chunk_id").alias("source_chunk_id"), F.lit(True).alias("there"))
    rows = relations.join(ids, "source_chunk_id", "left")
    reason = (
        F.when(~F.col("relation_type").isin(*kinds), "unknown relation type")
        .when(F.coalesce("source_chunk_id", F.lit("")) == "", "no source chunk")
        .when(F.coalesce("doc_id", F.lit("")) == "", "no document")
        .when(F.coalesce("extractor_version", F.lit("")) == "", "no extractor version")
        .when(F.col("there").isNull(), "source chunk missing")
    )
    rows = rows.withColumn("reason", reason).drop("there")
    return rows.where("reason IS NULL").drop("reason"), rows.where("reason IS NOT NULL")


def upsert_entities(base: DataFrame, new: DataFrame) -> DataFrame:
    """id, name, type, scope_keys, aliases: the new row's fields win, sets are united."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    rows = base.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return rows.groupBy("id").agg(F.max_by("name", "age").alias("name"), F.max_by("type", "age").alias("type"), union("scope_keys").alias("scope_keys"), union("aliases").alias("aliases"))


def upsert_edges(base: DataFrame, new: DataFrame, key: tuple[str, ...] = ("src", "dst", "relation_type", "source_chunk_id", "doc_id", "extractor_version")) -> DataFrame:
    """One edge a key; the newest confidence stays, the best is told too."""
    rows = base.withColumn("age", F.lit(0)).unionByName(new.withColumn("age", F.lit(1)))
    return rows.groupBy(*key).agg(F.max_by("confidence", F.struct("age", "confidence")).alias("confidence"), F.max("confidence").alias("best_confidence"))


PAYLOAD = "entities array<struct<id:string,type:string,name:string,aliases:array<string>>>, relations array<struct<source:string,target:string,type:string,confidence:double>>"


def parse_payload(payload: Column) -> Column:
    """Entities and relations of an extraction's JSON; rows that lack a required field go, bad JSON gives none."""
    got = F.from_json(payload, PAYLOAD)
    need = lambda x, *names: ~F.exists(F.array(*[F.coalesce(x[n], F.lit("")) for n in names]), lambda v: v == "")
    return F.struct(
        F.coalesce(F.filter(got["entities"], lambda e: need(e, "id", "type", "name")), F.array().cast("array<struct<id:string,type:string,name:string,aliases:array<string>>>")).alias("entities"),
        F.coalesce(F.filter(got["relations"], lambda r: need(r, "source", "target", "type")), F.array().cast("array<struct<source:string,target:string,type:string,confidence:double>>")).alias("relations"),
    )


def descendants(links: DataFrame, roots: DataFrame, depth: int = 16) -> DataFrame:
    """root, id, depth of everything below the roots (column id), roots included, in a tree of (id, parent_id)."""
    front = roots.select(F.col("id").alias("root"), "id")
    out = front.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        front = front.withColumnRenamed("id", "up").join(links.withColumnRenamed("parent_id", "up"), "up").select("root", "id")
        if front.isEmpty():
            break
        out = out.unionByName(front.withColumn("depth", F.lit(d)))
    return out
