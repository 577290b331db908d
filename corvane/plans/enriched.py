"""Enrichment of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators import enrichment
from corvane.plans.adapters import DOCUMENTS, documents, tokens_sql
from corvane.plans.registry import query

#: texts (doc_id, batch, name, text) of CTE `a` -> sentences with their centrality and terms with their weights, as the default provider has them
_PROVIDER = r"""s{a} AS (SELECT doc_id, batch, i, sent, {tokens} AS toks FROM (SELECT doc_id, batch, unnest(l) AS sent, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, batch, list_filter(list_transform(string_split(regexp_replace(text, '([.!?。！？])[ \t\n\r\f\x0B]+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM {a}))),
c{a} AS (SELECT doc_id, batch, i, t, count(*) AS n FROM (SELECT doc_id, batch, i, unnest(toks) AS t FROM s{a}) GROUP BY ALL),
w{a} AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id, batch, i)) AS w FROM c{a}),
t{a} AS (SELECT doc_id, batch, t, sum(w) AS total FROM w{a} GROUP BY ALL),
r{a} AS (SELECT doc_id, batch, i, round(sum(w * total) - 1, 9) AS r FROM w{a} JOIN t{a} USING (doc_id, batch, t) GROUP BY ALL),
b{a} AS (SELECT * FROM s{a} LEFT JOIN r{a} USING (doc_id, batch, i) QUALIFY row_number() OVER (PARTITION BY doc_id, batch ORDER BY coalesce(r, -1) DESC, i) <= 3),
m{a} AS (SELECT doc_id, batch, left(string_agg(sent, ' ' ORDER BY i), 1200) AS summary FROM b{a} GROUP BY ALL),
k{a} AS (SELECT doc_id, batch, list(t ORDER BY round(total, 9) DESC, t)[1:12] AS keywords FROM t{a} WHERE length(t) >= 4 GROUP BY ALL),
p{a} AS (SELECT doc_id, batch, coalesce(summary, '') AS summary, coalesce(keywords, []) AS keywords FROM {a} LEFT JOIN m{a} USING (doc_id, batch) LEFT JOIN k{a} USING (doc_id, batch))"""


def _sql() -> str:
    provider = lambda a: _PROVIDER.format(a=a, tokens=tokens_sql("sent"))
    return rf"""WITH RECURSIVE {DOCUMENTS},
l AS (SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS seq, line FROM (SELECT id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM (SELECT id, string_split(text, chr(10)) AS ls FROM docs)) WHERE line <> ''),
z AS (SELECT *, greatest(1, length(line) // 4) AS n FROM l),
f AS (SELECT doc_id, seq, n AS used, 0 AS batch FROM z WHERE seq = 0 UNION ALL SELECT z.doc_id, z.seq, CASE WHEN f.used + z.n > 6000 THEN z.n ELSE f.used + z.n END, CASE WHEN f.used + z.n > 6000 THEN f.batch + 1 ELSE f.batch END FROM f JOIN z ON z.doc_id = f.doc_id AND z.seq = f.seq + 1),
x AS (SELECT doc_id, batch, string_agg(line, chr(10) || chr(10) ORDER BY seq) AS text FROM f JOIN z USING (doc_id, seq) GROUP BY ALL),
{provider("x")},
v AS (SELECT doc_id, 0 AS batch, string_agg('分段 ' || (batch + 1) || ': ' || summary, chr(10) || chr(10) ORDER BY batch) AS text FROM px GROUP BY doc_id HAVING count(*) > 1),
{provider("v")},
n AS (SELECT doc_id, count(*) AS batches FROM x GROUP BY doc_id), e AS (SELECT * FROM pv UNION ALL SELECT px.* FROM px JOIN n USING (doc_id) WHERE batches = 1)
SELECT d.id AS doc_id, CASE WHEN n.batches IS NULL THEN 'failed' ELSE 'completed' END AS status, coalesce(summary, '') AS summary, coalesce(array_to_string(keywords, ','), '') AS keywords,
  coalesce(array_to_string(list_transform(keywords[1:3], lambda k: left('What does ' || d.name || ' say about ' || k || '?', 200)), ' '), '') AS questions,
  CASE WHEN n.batches IS NULL THEN 'Document has no parent chunks for enrichment' ELSE '' END AS error, coalesce(batches, 0) AS batches FROM docs d LEFT JOIN n ON n.doc_id = d.id LEFT JOIN e ON e.doc_id = d.id"""


@query("u7_enrichment", _sql())
def u7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines are its parent chunks."""
    docs = documents(spark, sf_dir).select(F.col("id").alias("doc_id"), "name", "text")
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    parents = docs.select("doc_id", F.posexplode(lines).alias("seq", "content")).select("doc_id", "seq", F.concat_ws("::", "doc_id", F.col("seq").cast("string")).alias("chunk_id"), "content", F.lit(None).cast("int").alias("token_count"))
    rows = enrichment.enrich(docs.select("doc_id", "name"), parents, enrichment.centrality_provider())
    text = lambda c, by: F.coalesce(F.array_join(c, by), F.lit("")).alias(c.replace("suggested_", ""))
    return rows.select("doc_id", "status", F.coalesce("summary", F.lit("")).alias("summary"), text("keywords", ","), text("suggested_questions", " "), "error", "batches")
