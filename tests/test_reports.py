import json

import pytest
from pyspark.sql import Row

from rubrica.plans import reports as R

CARD = Row(artifact_type="skill", path="a|b", composite=79.0, composite_raw=83.55, grade="C+", security_capped=True, foundational_capped=False, rules_run=27, tokens=1234, dimensions=[Row(dimension="security", label="Security", score=17.75, grade="F", weight=0.2, findings=1)], top_fixes=[Row(rule_id="SK401", severity="error", dimension="security", message="m", fix="Remove it.", count=2, gain=4.5, projected_composite=83.5, projected_grade="B")])
FINDING = Row(severity="error", rule_id="SK401", dimension="security", message="x | y\nz " + "long " * 30, file="SKILL.md", line=3, tool_name=None)


def test_markdown_and_terminal():
    md = R.markdown(CARD, [FINDING], "B")
    assert "**Grade:** B → C+" in md and "| Security | 18 | F | 1 |" in md and "x \\| y z" in md and "`SKILL.md:3`" in md and "1. **SK401** ×2 — Remove it. (+4.5 → B 83.5)" in md
    text = R.terminal(CARD, [FINDING])
    assert "cap the grade at C+ (uncapped: 84)" in text and all(len(x) <= 81 for x in text.split("\n")) and "Findings" not in R.terminal(CARD, [FINDING], True)
    assert "overall **C+**" in R.repo_markdown([CARD])


def test_badges_and_rules():
    assert R.badge("A+") == R.badge("A+") and "#e05d44" in R.badge("F") and "#97ca00" in R.badge("B+")
    with pytest.raises(ValueError):
        R.badge("E")
    assert R.rules_document().count("\n| SK") == 27 and R.rules_document().count("\n| MCP") == 23


def test_documents_of_cards_rename_without_lambdas(spark, tmp_path):
    dims = [("security", "Security", 17.75, "F", 0.2, 1)]
    fixes = [("SK401", "error", "security", "m", "Remove it.", 2, 4.5, 83.5, "B")]
    schema = """artifact_type string, path string, name string, tokens long, rules_run int, dimensions array<struct<dimension:string,label:string,score:double,grade:string,weight:double,findings:long>>, composite double, composite_raw double, grade string, security_capped boolean,
        foundational_capped boolean, n_error long, n_warn long, n_info long, top_fixes array<struct<rule_id:string,severity:string,dimension:string,message:string,fix:string,count:long,gain:double,projected_composite:double,projected_grade:string>>"""
    spark.createDataFrame([("skill", "p", "n", 1, 27, dims, 79.0, 83.55, "C+", True, False, 1, 0, 0, fixes)], schema).write.parquet(f"{tmp_path}/c")
    out = R.card_documents(spark.read.parquet(f"{tmp_path}/c"))
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()
    doc = json.loads(out.first().card)
    assert doc["dimensions"] == [{"dimension": "security", "label": "Security", "score": 17.75, "grade": "F", "weight": 0.2, "findingCount": 1}]
    assert doc["topFixes"] == [{"ruleId": "SK401", "severity": "error", "dimension": "security", "message": "m", "fix": "Remove it.", "count": 2, "gain": 4.5, "projectedComposite": 83.5, "projectedGrade": "B"}]
