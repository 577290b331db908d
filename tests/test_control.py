import pytest
from pyspark.sql import functions as F

from corvane.functions import control
from corvane.operators import pdf


def test_arguments():
    schema = {"required": ["q"], "additionalProperties": False, "properties": {"q": {"type": "string"}, "k": {"type": "integer", "minimum": 1, "maximum": 20}, "deep": {"type": "boolean"}, "ids": {"type": "array"}, "mode": {"enum": ["a", "b"]}}}
    assert control.checked_arguments(schema, {"q": "x", "k": "7", "deep": "true", "ids": "one", "mode": "a"}) == ({"q": "x", "k": 7, "deep": True, "ids": ["one"], "mode": "a"}, [])
    assert control.checked_arguments(schema, {"k": 99, "z": 1, "deep": "maybe", "mode": "c"})[1] == ["missing: q", "out of range: k", "unknown: z", "not boolean: deep", "not allowed: mode"]


def test_templates():
    assert control.rendered("Say {{ what }}", {"what"}, {"what": "<b>"}, xml=True) == "Say &lt;b&gt;"
    with pytest.raises(ValueError, match="undeclared"):
        control.rendered("{{x}}", set(), {"x": 1})
    with pytest.raises(ValueError, match="no value"):
        control.rendered("{{x}}", {"x"}, {})


def test_settings():
    got, told = control.resolved({"size": 512, "mode": "auto"}, {"size": (64, 4096)}, {"size": 9000}, {"mode": "legacy", "odd": 1})
    assert got == {"size": 4096, "mode": "legacy"} and len(told) == 2


def test_pdf_rules(spark):
    rows = spark.createDataFrame([(1, "short"), (2, "A readable sentence, long enough to count."), (3, "a\nb\nc\nd\ne\nf\ng\nh\ni\nj\nk"), (4, "INTRODUCTION\n\n1.2 Scope\nSome text.\nALL DONE.")], "id int, t string")
    got = {r["id"]: (r["q"], r["p"]) for r in rows.select("id", pdf.text_quality(F.col("t")).alias("q"), pdf.promoted(F.col("t")).alias("p")).collect()}
    assert got[1][0] == 0.0 and got[2][0] > 0.95 and got[3][0] == pytest.approx(0.9)
    assert got[4][1] == "## INTRODUCTION\n## 1.2 Scope\nSome text.\nALL DONE."
