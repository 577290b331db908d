"""Which tools answer which kind of question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as X

# Tools by question type, in order: (tool, action, required).
RAG, GRAPH, KEYWORD = "raw_rag", "graph_retriever", "keyword_search"
PLANS: dict[str, tuple[tuple[str, str, bool], ...]] = {
    "source": ((RAG, "search", False),),
    "dependency": ((GRAPH, "path_search", True), (RAG, "search", False)),
    "impact": ((GRAPH, "neighbor_search", True), (RAG, "search", False)),
    "troubleshooting": ((GRAPH, "entity_search", False), (RAG, "search", False), (KEYWORD, "search", False)),
    "comparison": ((RAG, "search", False), (GRAPH, "entity_search", False)),
    "howto": ((RAG, "search", False), (KEYWORD, "search", False)),
    "decision": ((RAG, "search", False), (KEYWORD, "search", False)),
    "summary": ((RAG, "search", False), (GRAPH, "entity_search", False)),
    "fact": ((RAG, "search", False), (GRAPH, "entity_search", False)),
}
EXACT_TERMS = (r"[\w./-]+\.(?:md|txt|pdf|docx|html|json|csv)", r"\b[A-Z]{2,}[-_]?\d{2,}\b", r"\"[^\"]{3,}\"", r"\b0x[0-9A-Fa-f]+\b", r"\b\d+\.\d+\.\d+\b", r"\b[a-z]+_[a-z_]+\b")
RETRIEVERS = ("knowledge_search", "query_knowledge_graph", "list_knowledge_chunks", "get_document_info")


def plan_table(spark: SparkSession, limits: dict[str, int] | None = None) -> DataFrame:
    """question_type, ord, tool, action, required, top_k."""
    limits = limits or {RAG: 8, GRAPH: 10, KEYWORD: 8}
    rows = [(kind, i, tool, action, need, limits[tool]) for kind, tools in PLANS.items() for i, (tool, action, need) in enumerate(tools)]
    return spark.createDataFrame(rows, "question_type string, ord int, tool string, action string, required boolean, top_k int")


def routed(questions: DataFrame) -> DataFrame:
    """query_id, question_type, confidence, graph_intent."""
    return questions.select("query_id", X.route(F.col("text")).alias("r")).select("query_id", "r.*")


def planned(routes: DataFrame, table: DataFrame, most: int = 4) -> DataFrame:
    """A row per planned tool. The plan table is fixed and tiny, so it is the broadcast side."""
    return routes.join(F.broadcast(table), "question_type").where(F.col("ord") < most)


def needs_exact_terms(question) -> object:
    out = F.lit(False)
    for p in EXACT_TERMS:
        out = out | question.rlike(p)
    return out


def blocked(runs: DataFrame) -> DataFrame:
    """Adds blocked: keyword search must come first, has not, the question names something exact, and the batch retrieves without it.

    runs: question, tools (array), grep_first, grep_done.
    """
    retrieves = F.arrays_overlap("tools", F.array(*[F.lit(t) for t in RETRIEVERS]))
    return runs.withColumn("blocked", F.col("grep_first") & ~F.col("grep_done") & needs_exact_terms(F.col("question")) & ~F.array_contains("tools", "grep_chunks") & retrieves)
