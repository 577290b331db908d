"""Schemas of the engine's tables and the checks on them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations.
CHUNK_TYPES = ("parent", "child", "table", "ocr", "image_ocr", "image_caption")
INDEXABLE_TYPES = ("child", "table", "ocr", "image_ocr", "image_caption")
DIRECT_TYPES = ("child", "table", "image_ocr", "image_caption")
SCHEMA_VERSION = "1.0"

DOCUMENT = "id string, workspace_id string, knowledge_base_id string, name string, storage_path string, file_type string, parse_status string, summary_status string, created_at timestamp, updated_at timestamp"
CHUNK = "id string, doc_id string, parent_id string, chunk_type string, title_path string, content string, content_markdown string, page_start int, page_end int, token_count int, metadata map<string,string>"
HIT = "query_id bigint, chunk_id string, doc_id string, parent_id string, content string, vector_score double, keyword_score double, bm25_score double, hybrid_score double, reranker_score double"


def assert_schema(df: DataFrame, expected: str) -> DataFrame:
    """df, if it has every expected column (of a schema string) with the expected type; raises otherwise."""
    have = {f.name: f.dataType for f in df.schema}
    wrong = [f"{f.name}: {have.get(f.name)} instead of {f.dataType.simpleString()}" for f in T.StructType.fromDDL(expected) if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError("schema mismatch: " + "; ".join(wrong))
    return df


@dataclass(frozen=True)
class Scope:
    """What a caller may see: one workspace, one or more knowledge bases, and documents if any are named."""

    workspace_id: str
    knowledge_base_ids: tuple[str, ...]
    document_ids: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        object.__setattr__(self, "knowledge_base_ids", tuple(dict.fromkeys(i for i in self.knowledge_base_ids if i)))
        object.__setattr__(self, "document_ids", tuple(dict.fromkeys(i for i in self.document_ids if i)))
        if not self.knowledge_base_ids:
            raise ValueError("a scope needs at least one knowledge base")

    def predicate(self, workspace: str = "workspace_id", base: str = "knowledge_base_id", document: str = "doc_id") -> Column:
        """Plain comparisons, which reach the scan and prune partitions by workspace and knowledge base."""
        out = (F.col(workspace) == self.workspace_id) & F.col(base).isin(*self.knowledge_base_ids)
        return out & F.col(document).isin(*self.document_ids) if self.document_ids else out


def resolve_scope(requested: Sequence[str], bases: DataFrame, default_base: str) -> Scope:
    """Requested knowledge bases (the default if none), all of which must be active and of one workspace."""
    wanted = list(dict.fromkeys(r for r in requested if r)) or [default_base]
    found = bases.where(F.col("id").isin(*wanted) & (F.col("status") == "active")).select("id", "workspace_id").limit(len(wanted) + 1).collect()
    if {r["id"] for r in found} != set(wanted):
        raise ValueError("unknown or inactive knowledge base")
    spaces = {r["workspace_id"] for r in found}
    if len(spaces) != 1:
        raise ValueError("knowledge bases of several workspaces")
    return Scope(spaces.pop(), tuple(wanted))
