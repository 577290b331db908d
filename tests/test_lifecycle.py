from corvane.operators import lifecycle


def test_creations(spark):
    asked = [(1, "w", " Base A ", "document", 5), (2, "w", "base a", "document", 4), (3, "w", "\t", "document", 1), (4, "w", "B", "faq", 1), (5, "v", "C", "document", 1), (6, "w", "OLD", "document", 1), (7, "x", "C", "document", 1), (8, "w", None, "document", 1), (9, "w", "D", None, 1)]
    requests = spark.createDataFrame(asked, "id long, workspace_id string, name string, type string, ord long")
    bases = spark.createDataFrame([("w", "old")], "workspace_id string, name string")
    spaces = spark.createDataFrame([("w", "active"), ("v", "archived")], "workspace_id string, status string")
    got = {r["id"]: r["reason"] for r in lifecycle.judged_creations(requests, bases, spaces).collect()}
    gone = "workspace missing or archived"
    assert got == {1: "name exists", 2: "", 3: "empty name", 4: "unsupported type", 5: gone, 6: "name exists", 7: gone, 8: "empty name", 9: "unsupported type"}
    assert lifecycle.judged_creations(requests.where("false"), bases, spaces).count() == 0


def test_statuses(spark):
    bases = spark.createDataFrame([(1, "active"), (2, "archived"), (3, "active")], "id long, status string")
    changes = spark.createDataFrame([(1, "archive"), (2, "archive"), (3, "archive"), (4, "restore")], "id long, action string")
    judged = lifecycle.judged_statuses(bases, changes, 1)
    assert {r["id"]: (r["status"], r["reason"]) for r in judged.collect()} == {1: ("active", "default base"), 2: ("archived", "not found"), 3: ("archived", ""), 4: (None, "not found")}
    assert {r["id"]: r["status"] for r in lifecycle.with_statuses(bases, judged).collect()} == {1: "active", 2: "archived", 3: "archived"}


def test_worker_outcomes(spark):
    tasks = spark.createDataFrame([(i, i, 1 if i < 5 else 2) for i in range(1, 7)] + [(7, 9, 1)], "task_id long, file_id long, batch_id long")
    files = spark.createDataFrame([(1, "indexed", None), (2, "failed", ""), (3, "failed", "bad"), (4, "canceled", None), (5, "failed", "bad"), (6, None, None)], "file_id long, status string, error_message string")
    batches = spark.createDataFrame([(1, "running"), (2, "canceled")], "batch_id long, status string")
    got = {r["task_id"]: (r["outcome"], r["message"], r["retry"]) for r in lifecycle.worker_outcomes(tasks, files, batches).collect()}
    assert got == {1: ("completed", "", False), 2: ("failed", "Upload file processing failed", True), 3: ("failed", "bad", True), 4: ("canceled", "", False), 5: ("canceled", "", False), 6: ("canceled", "", False), 7: ("missing", "", False)}


def test_understood(spark):
    rows = spark.createDataFrame([(1, " a ", ["b", "a", " ", "b ", "c", "d", "e", "f"]), (2, "  ", ["x"]), (3, "q", None), (4, None, [None])], "query_id long, text string, rewrites array<string>")
    got = {r["query_id"]: (r["retrieval_queries"], r["understood_by"]) for r in lifecycle.understood(rows, "text", "rewrites").collect()}
    assert got == {1: (["a", "b", "c", "d", "e"], "llm"), 2: (["  "], "fallback"), 3: (["q"], "fallback"), 4: ([""], "fallback")}
