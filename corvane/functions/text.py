"""Column functions over text: normalisation, tokens, redaction, language, routing, memory keys. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\r\f\x0B]+"
CJK = r"[\x{4e00}-\x{9fff}]"

# Markers and rules that decide results.
REDACT = r"""(?i)(authorization|password|passwd|token|api[_-]?key|secret|client[_-]?secret)(['"\s:=]+)([^,'"\s&}]+)"""
BEARER = r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+"
GERMAN = r"(?U)(?i)\b(?:der|die|das|und|Kapitel)\b"
ROUTES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("source", "", ("which source", "source", "citation", "出处", "来源", "哪份文档")),
    ("howto", "", ("how do i", "how to", "configure", "setup", "install", "如何", "怎么")),
    ("troubleshooting", "Error/Config/Service", ("error", "failed", "failure", "exception", "timeout", "troubleshoot", "报错", "故障", "异常")),
    ("comparison", "", ("compare", "versus", "vs", "difference", "对比", "比较")),
    ("impact", "impact", ("impact", "affected", "affect", "unavailable", "down", "影响", "波及")),
    ("dependency", "path", ("depend", "dependency", "depends on", "依赖")),
    ("summary", "", ("summarize", "summary", "概括", "总结")),
    ("decision", "", ("should", "choose", "decide", "recommend", "是否应该", "选择", "决策", "帮我选", "选一款", "选型", "推荐")),
)
REMEMBER, FORGET = ("记住", "请记住", "remember"), ("忘记", "不要记住", "forget")
SECRET_MARKERS = ("api_key", "apikey", "password", "token", "secret", "sk-")
PREFERENCE, MANNER = ("以后", "偏好", "喜欢", "请用", "回答"), ("中文", "简洁", "英文", "详细")
INSUFFICIENT = ("cannot determine", "insufficient", "无法确定", "证据不足")
EDGES = " 。.，,"


def any_contains(text: Column, needles: Sequence[str]) -> Column:
    out = F.lit(False)
    for n in needles:
        out = out | text.contains(n)
    return out


def collapse(text: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "))


def normalized(text: Column) -> Column:
    return F.lower(collapse(text))


def signature(text: Column, size: int = 500) -> Column:
    """What two contents share that count as the same: the first characters of the normalised text."""
    return F.left(normalized(text), F.lit(size))


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("int")


def index_tokens(text: Column) -> Column:
    """Tokens of the inverted index: runs of letters, digits and underscores, lower case, two characters or more."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) >= 2)


def query_terms(text: Column) -> Column:
    """Distinct tokens of a keyword query: as the index cuts them, after outer marks go."""
    return F.array_distinct(index_tokens(text))


def overlap_tokens(text: Column) -> Column:
    """Tokens of the index-free fallback: CJK runs and ASCII words of two or more, longer CJK runs also as pairs; distinct, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(rf"({CJK}{{2,}}|[A-Za-z0-9_]{{2,}})"), 1)
    pairs = lambda t: F.when(t.rlike(rf"^{CJK}{{3,}}$"), F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(found, lambda t: F.concat(F.array(t), pairs(t)))))


def redact(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, REDACT, "$1$2***"), BEARER, "Bearer ***")


def truncate(text: Column, limit: int) -> Column:
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.left(text, F.lit(limit)), F.lit("... [truncated]")))


def sanitize_error(text: Column, data_dir: str, limit: int = 500) -> Column:
    return F.left(collapse(F.regexp_replace(redact(text), _quoted(data_dir), "[data]")), F.lit(limit))


def _quoted(literal: str) -> str:
    return "\\Q" + literal + "\\E"


def languages(text: Column) -> Column:
    """Array of language codes from the first 4096 characters."""
    head = F.left(text, F.lit(4096))
    cjk, latin = F.regexp_count(head, F.lit(CJK)), F.regexp_count(head, F.lit("[A-Za-z]"))
    total = F.greatest(F.lit(1), cjk + latin)
    return (
        F.when(F.length(head) == 0, F.array().cast("array<string>"))
        .when((cjk / total >= 0.15) & (latin / total >= 0.15), F.array(F.lit("zh"), F.lit("en")))
        .when(cjk / total > 0.30, F.array(F.lit("zh")))
        .when(head.rlike(GERMAN), F.array(F.lit("de")))
        .otherwise(F.array(F.lit("en")))
    )


def route(question: Column) -> Column:
    """Struct (question_type, confidence, graph_intent); the first rule that matches wins."""
    text = F.trim(F.coalesce(question, F.lit("")))
    low = F.lower(text)
    say = lambda kind, sure, intent: F.struct(F.lit(kind).alias("question_type"), F.lit(sure).alias("confidence"), F.lit(intent).alias("graph_intent"))
    out = F.when(text == "", say("fact", 0.0, ""))
    for kind, intent, needles in ROUTES:
        out = out.when(any_contains(low, needles), say(kind, 0.75, intent))
    return out.otherwise(say("fact", 0.65, ""))


def mentions(text: Column) -> Column:
    """Capitalised runs and terms with technical endings, distinct, six at most."""
    runs = F.regexp_extract_all(text, F.lit(r"(?U)(\b[A-Z][A-Za-z0-9_-]*(?:\s+[A-Z][A-Za-z0-9_-]*)*\b)"), 1)
    terms = F.regexp_extract_all(text, F.lit(r"(?U)(\b[A-Za-z]+(?:DB|API|SQL|Redis|Gateway|Service|PostgreSQL)\b)"), 1)
    return F.slice(F.array_distinct(F.concat(runs, terms)), 1, 6)


def named_files(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?i)((?U)[\w./-]+\.(?:md|txt|pdf|docx|html|json|csv))"), 1))


def split_entities(question: Column) -> Column:
    """The parts around "depend on", "depends on" or 依赖, else the first two around "and"."""
    strip = lambda a: F.filter(F.transform(a, lambda p: F.trim(F.translate(p, "?。", ""))), lambda p: p != "")
    low = F.lower(question)
    out = F.when(low.contains(" depend on "), strip(F.split(question, " depend on ")))
    out = out.when(low.contains(" depends on "), strip(F.split(question, " depends on "))).when(low.contains("依赖"), strip(F.split(question, "依赖")))
    return out.otherwise(F.slice(strip(F.split(F.regexp_replace(question, r"\?", ""), " and ")), 1, 2))


def snippet(content: Column, query: Column, before: int = 80, after: int = 180, head: int = 260) -> Column:
    """The content around the first place of the first query term that occurs, else its beginning."""
    terms = F.filter(F.split(query, r"\||\s+"), lambda t: t != "")
    spots = F.filter(F.transform(terms, lambda t: F.instr(F.lower(content), F.lower(t))), lambda i: i > 0)
    at = F.try_element_at(spots, F.lit(1)) - 1
    start = F.greatest(F.lit(0), at - before)
    window = F.substring(content, start + 1, F.least(F.length(content), at + after) - start)
    flat = lambda c: F.translate(F.trim(c), "\n", " ")
    return F.when(at.isNull(), truncate(flat(content), head)).otherwise(truncate(flat(window), 300))


def stable_id(*parts: Column, length: int = 32, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, length))


def memory_kind(text: Column) -> Column:
    """'remember', 'preference', 'forget' or null for a message."""
    return (
        F.when(any_contains(text, FORGET), F.lit("forget"))
        .when(any_contains(text, REMEMBER), F.lit("remember"))
        .when(any_contains(text, PREFERENCE) & any_contains(text, MANNER), F.lit("preference"))
    )


def memory_key(text: Column) -> Column:
    return F.concat(F.lit("memory:"), F.substring(F.sha1(text), 1, 12))


def memory_content(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.regexp_replace(text, r"(?i)^(请)?记住", ""), r"(?i)^remember", ""), F.lit(EDGES))


def sensitive(text: Column) -> Column:
    return any_contains(F.lower(text), SECRET_MARKERS)


def clamp(value: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), value))


def retrieval_score(reranker: Column, hybrid: Column, vector: Column, keyword: Column) -> Column:
    """The score that counts, by presence."""
    return F.coalesce(reranker, hybrid, vector, keyword, F.lit(0.0))


def visible_text(page: Column) -> Column:
    """Text of a page by patterns: scripts, styles and tags out, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]+>", " ")
    return collapse(bare)
