import datetime

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import context, evaluate, fusion, graph, jobs, memory, records, search
from corvane.schemas import Scope, assert_schema
from corvane.sources import files
from corvane.streaming import tasks


def test_scope_rules():
    assert Scope("w", ("a", "b", "a")).knowledge_base_ids == ("a", "b")
    with pytest.raises(ValueError):
        Scope("w", ())


def test_assert_schema(spark):
    with pytest.raises(ValueError, match="id"):
        assert_schema(spark.range(1), "id string")


def test_weighted_rrf_example(spark):
    dense = spark.createDataFrame([(1, "shared", 1, 0.9), (1, "dense", 2, 0.8)], "query_id long, chunk_id string, rank int, score double")
    words = spark.createDataFrame([(1, "shared", 1, 3.0), (1, "word", 2, 2.0)], "query_id long, chunk_id string, rank int, score double")
    fused = fusion.fused_cut(fusion.weighted_rrf({"dense": (dense, 0.7), "words": (words, 0.3)}), "rrf").orderBy("position").collect()
    assert [r["chunk_id"] for r in fused] == ["shared", "dense", "word"]
    assert fused[0]["rrf"] == pytest.approx(1 / 61)
    total = fusion.weighted_sum({"d": (dense.where("chunk_id = 'dense'").withColumn("score", F.lit(0.7)), 0.2), "w": (words.where("chunk_id = 'word'"), 0.3)}).orderBy(F.desc("score")).collect()
    assert [(r["chunk_id"], round(r["score"], 6)) for r in total] == [("word", 0.6), ("dense", 0.14)]


HITS = "query_id long, chunk_id string, parent_id string, doc_id string, content string, score double, position int"


def test_near_duplicates_and_diversity(spark):
    rows = [(1, "a", "p1", "d", "the quick brown fox jumps over the dog", 0.9, 1), (1, "b", "p2", "d", "The  quick brown fox jumps over the dog", 0.8, 2), (1, "c", "p1", "d", "else", 0.7, 3), (1, "e", "p3", "d", "the quick brown fox jumps over the dot", 0.6, 4), (1, "f", "p4", "d", "completely different words here", 0.5, 5)]
    hits = spark.createDataFrame(rows, HITS)
    assert sorted(r["chunk_id"] for r in fusion.drop_near_duplicates(hits).collect()) == ["a", "f"]
    best = fusion.diverse(hits.drop("position"), 2).orderBy("position").collect()
    assert [r["chunk_id"] for r in best] == ["a", "c"]


def test_similarity():
    assert fusion.similarity("abc", "xx abc") == 0.5 and fusion.similarity("", "a") == 0.0
    assert fusion.similarity("abcd", "abce") == 0.75


def test_gate(spark):
    rows = spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.2), (2, "a", 0.2), (2, "b", 0.1), (3, "a", 0.05), (3, "b", 0.01)], "query_id long, chunk_id string, reranker_score double")
    got = sorted((r["query_id"], r["chunk_id"], r["gate"]) for r in fusion.gate(rows).collect())
    assert got == [(1, "a", "threshold"), (2, "a", "fallback"), (3, "a", "least")]


def test_pack_skips_and_goes_on(spark):
    rows = spark.createDataFrame([(1, "a", 0.9, 100), (1, "b", 0.8, 950), (1, "c", 0.7, 50), (2, "x", 0.5, 5000)], "query_id long, parent_id string, score double, token_count int")
    got = sorted((r["query_id"], r["position"], r["parent_id"], r["used"]) for r in context.pack(rows, 1000).collect())
    assert got == [(1, 1, "a", 100), (1, 2, "c", 150), (2, 1, "x", 5000)]


def test_merge_contexts(spark):
    a = "start of a passage that is long enough to overlap with another one"
    rows = [(1, "a", "p1", "d", a, 0.9, 1), (1, "b", "p1", "d", "same parent", 0.8, 2), (1, "c", "p2", "d", a, 0.7, 3), (1, "e", "p3", "d2", a, 0.6, 4)]
    got = context.merge_contexts(spark.createDataFrame(rows, HITS)).orderBy("position").collect()
    assert [list(r["chunk_ids"]) for r in got] == [["a", "b", "c"], ["e"]]


def test_expand_short(spark):
    rows = spark.createDataFrame([("d", f"c{i}", i, "x" * 100) for i in range(5)], "doc_id string, chunk_id string, seq int, content string")
    got = {r["chunk_id"]: r for r in context.expand_short(rows).collect()}
    assert list(got["c2"]["neighbours"]) == ["c1", "c3"] and len(got["c2"]["content"]) == 304
    assert list(got["c0"]["neighbours"]) == ["c1", "c2"]


def test_search_agrees_with_joined_scores(spark):
    chunks = spark.createDataFrame([("a", "red fox red"), ("b", "blue fox"), ("c", "green tree with leaves"), ("d", "")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "red fox"), (2, "tree"), (3, "zzz"), (4, "")], "query_id long, text string")
    top = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in search.keyword_search(chunks, queries, 10).collect()}
    full = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in search.bm25_scores(chunks, queries).collect()}
    assert set(top) == set(full) and all(top[k] == pytest.approx(full[k], abs=1e-8) for k in top)
    assert {k for k in top} == {(1, "a"), (1, "b"), (2, "c")}


def test_nearest_edge_cases(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    assert [r["vec_id"] for r in search.nearest(rows, asked, 5).orderBy("rank").collect()] == [2, 3]
    assert search.nearest(rows, asked.where("query_id > 5"), 5).count() == 0


def test_overlap_tokens_of_cjk(spark):
    row = spark.createDataFrame([("查询数据 ABC d",)], "t string").select(X.overlap_tokens(F.col("t")).alias("x")).first()
    assert list(row["x"]) == ["查询数据", "查询", "询数", "数据", "abc"]


def test_redaction_and_memory(spark):
    said = ["password: hunter2 and Bearer abc.def", "请记住 项目用 Spark。", "以后请用中文回答", "记住 my api_key is sk-1", "忘记它", "plain"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "id int, text string")
    assert rows.where("id = 0").select(X.redact(F.col("text"))).first()[0] == "password: *** and Bearer ***"
    got = {r["id"]: (r["kind"], r["content"], r["key"]) for r in memory.extract(rows).collect()}
    assert set(got) == {1, 2} and got[1][1] == "项目用 Spark" and got[2][2] == "language"


def test_mentions_are_unicode_words(spark):
    row = spark.createDataFrame([("Der Alte MySQL-Server, éAbc, report.PDF",)], "t string").select(X.mentions(F.col("t")).alias("m"), X.named_files(F.col("t")).alias("f")).first()
    assert list(row["m"])[:1] == ["Der Alte MySQL-Server"] and list(row["f"]) == ["report.PDF"]


def test_graph_walks(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "c"), ("e4", "c", "c")], "edge_id string, src string, dst string")
    got = graph.paths(edges, "a", "c", 3).collect()
    assert [list(r["edge_ids"]) for r in got][:2] == [["e3"], ["e1", "e2"]]
    seeds = spark.createDataFrame([("a",)], "node string")
    assert {(r["node"], r["depth"]) for r in graph.neighbours(edges, seeds, 2).collect()} == {("b", 1), ("c", 1)}


def test_entity_upsert(spark):
    kind = "id string, name string, type string, scope_keys array<string>, aliases array<string>"
    out = graph.upsert_entities(spark.createDataFrame([("1", "old", "t", ["x"], None)], kind), spark.createDataFrame([("1", "new", "t", ["y"], ["n"])], kind)).first()
    assert out["name"] == "new" and list(out["scope_keys"]) == ["x", "y"] and list(out["aliases"]) == ["n"]


def test_task_rules_agree(spark):
    """The batch fold and the streaming step give the same states for all short logs."""
    from itertools import product

    actions = ("create", "claim", "heartbeat", "error", "complete")
    logs = [log for n in (1, 2, 3, 4) for log in product(actions, repeat=n)] + [("create",) + ("claim", "error") * 4 + ("complete",)]
    at = datetime.datetime(2024, 1, 1)
    rows = [(i, at + datetime.timedelta(seconds=k), k, a) for i, log in enumerate(logs) for k, a in enumerate(log)]
    folded = {r["task_id"]: (r["status"], r["attempts"]) for r in jobs.fold_tasks(spark.createDataFrame(rows, "task_id long, ts timestamp, event_id long, action string")).collect()}
    for i, log in enumerate(logs):
        status, attempts = "none", 0
        for a in log:
            status, attempts, _ = tasks.step(status, attempts, a)
        assert folded[i] == (status, attempts), log
    assert folded[len(logs) - 1][0] == "dead"


def test_dependents():
    assert jobs.dependents("load") == ["chunk", "index", "multimodal", "postprocess"] and jobs.dependents("postprocess") == []


def test_guarded_sql(spark):
    assert records.guarded_sql(spark, "select 1 AS x", 5).first()["x"] == 1
    for bad in ("drop table x", "select 1; select 2", "with a as (delete from b) select 1", "update t set a = 1"):
        with pytest.raises(ValueError):
            records.guarded_sql(spark, bad)


def test_evaluation_rates(spark):
    row = spark.range(1).select(
        evaluate.citation_rate(F.lit(3), F.lit(2)).alias("a"),
        evaluate.tool_rate(F.array(F.lit("x")), F.array(F.lit("y")), F.array(F.lit("x"), F.lit("y"))).alias("b"),
        evaluate.insufficient_rate(F.lit(True), F.lit("We Cannot Determine it")).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == (1.0, 0.5, 1.0)


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("größe".encode("utf-8-sig"))
    (tmp_path / "b.txt").write_bytes("查询".encode("gb18030"))
    (tmp_path / "c.html").write_text("<p>One &amp; two</p><script>x()</script><div>three<br>four</div>", "utf-8")
    (tmp_path / "d.csv").write_text("a,b\n1,2\n", "utf-8")
    (tmp_path / "e.json").write_text("{bad", "utf-8")
    (tmp_path / "~$f.txt").write_text("lock", "utf-8")
    found = files.folder(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: r for r in files.load(found).collect()}
    assert set(got) == {"a.txt", "b.txt", "c.html", "d.csv", "e.json"}
    assert got["a.txt"]["text"] == "größe" and got["b.txt"]["text"] == "查询"
    assert got["c.html"]["text"] == "One & two\nthree\nfour" and got["d.csv"]["text"] == "a | b\n1 | 2"
    assert got["e.json"]["text"] is None and got["e.json"]["error"].startswith("JSONDecodeError")
    first = files.manifest_signature(found).first()["signature"]
    (tmp_path / "g.txt").write_text("more", "utf-8")
    assert files.manifest_signature(files.folder(spark, str(tmp_path))).first()["signature"] != first


def test_evaluation_cases(spark, tmp_path):
    import json

    case = {"id": "c1", "question": "q", "query_type": "fact", "tags": [], "expected_answer_terms": ["a"], "expected_tools": [], "expect_insufficient_evidence": False}
    (tmp_path / "a.json").write_text(json.dumps({"schema_version": "1.0", "id": "s", "name": "n", "version": "1", "cases": [case]}))
    assert files.evaluation_cases(spark, str(tmp_path / "a.json")).first()["id"] == "c1"
    (tmp_path / "b.json").write_text(json.dumps({"schema_version": "2.0", "id": "s", "cases": [case]}))
    with pytest.raises(ValueError):
        files.evaluation_cases(spark, str(tmp_path / "b.json"))


def test_llm_is_separate():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "corvane"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "corvane.llm" not in p.read_text(), p


def test_nearest_answers_queries_of_every_length(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, None), (6, [0.0, 0.0])], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(10, [1.0, 0.0]), (11, [0.0, 1.0, 0.1])], "query_id long, vector array<double>")
    got = search.nearest(vectors, queries, 1).orderBy("query_id").collect()
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(10, 1), (11, 4)]


def test_expand_short_walks_many_documents_at_once(spark):
    import random

    def walked(texts, i, short, long):
        join = lambda at: "\n\n".join(t for t in (texts[j].strip() for j in at) if t)
        at, left, right = [i], i - 1, i + 1
        while len(join(at)) < short:
            grew = False
            if left >= 0:
                at, left, grew = [left, *at], left - 1, True
            if len(join(at)) >= short:
                break
            if right < len(texts):
                at, right, grew = [*at, right], right + 1, True
            if not grew or len(join(at)) >= long:
                break
        return (texts[i] if len(at) == 1 else join(at)[:long].rstrip() if len(join(at)) > long else join(at)), [f"c{j}" for j in at if j != i]

    rng = random.Random(4)
    docs = {f"d{k}": [rng.choice(["", " ", " a\u3000", "b" * 7, "c" * 19 + " ", "d " * 30]) for _ in range(1 + k % 9)] for k in range(150)}
    rows = spark.createDataFrame([(d, f"c{i}", i, t) for d, texts in docs.items() for i, t in enumerate(texts)], "doc_id string, chunk_id string, seq int, content string").repartition(3)
    got = context.expand_short(rows, 20, 50)
    assert {(r["doc_id"], r["chunk_id"]): (r["content"], r["neighbours"]) for r in got.collect()} == {(d, f"c{i}"): walked(texts, i, 20, 50) for d, texts in docs.items() for i in range(len(texts))}
    assert "FlatMapGroups" not in got._jdf.queryExecution().executedPlan().toString()
