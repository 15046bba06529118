import pytest

from rubrica.config import Config
from rubrica.operators import skill_rules
from rubrica.operators.engine import RuleCrash, computed_findings
from rubrica.operators.hits import hit
from rubrica.sources import trees as S
from rubrica.sources.files import FileTree, FileTreeReader, is_text

TREE = {
    "a/SKILL.md": "---\nname: a\n---\nbody\n",
    "a/data.bin": "\0\1",
    "a/.hidden.md": "hidden",
    "a/deep/notes.txt": "notes",
    "a/big.md": "x" * 300_000,
    ".cursor/rules/r.mdc": "y" * 300_000,
    "node_modules/m/SKILL.md": "no",
    "dist/x.md": "no",
    "skip/me.md": "no",
    "é ü.md": "umlaut",
}


@pytest.fixture
def tree(tmp_path):
    for p, c in TREE.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text(c)
    (tmp_path / "link.md").symlink_to(tmp_path / "a" / "SKILL.md")
    (tmp_path / "linked").symlink_to(tmp_path / "a")
    return tmp_path


def test_a_tree_by_uri_and_by_path(spark, tree):
    want = {p: (len(c.encode()), None if p in ("a/data.bin", "a/big.md") else c) for p, c in TREE.items() if not p.startswith(("node_modules", "dist", "skip"))}
    for root in (str(tree), f"file://{tree}"):
        df = S.read_tree(spark, root, "r", ("skip/*",))
        assert {r.path: (r.size, r.content) for r in df.collect()} == want and {r.repo for r in df.collect()} == {"r"}
    assert S.read_tree(spark, str(tree)).first().repo == str(tree)


def test_filters_on_paths_open_no_other_file(spark, tree):
    (tree / "a" / "locked.md").write_text("x")
    df = S.read_tree(spark, str(tree), "r")
    assert [r.path for r in df.where("path LIKE 'a/deep/%'").collect()] == ["a/deep/notes.txt"]
    assert sorted(r.path for r in df.where("path IN ('a/SKILL.md', 'x')").collect()) == ["a/SKILL.md"]
    from pyspark.sql.datasource import EqualTo, GreaterThan, StringEndsWith

    reader = FileTreeReader({"root": str(tree), "partition_bytes": "10"})
    rest = list(reader.pushFilters([StringEndsWith(("path",), ".txt"), GreaterThan(("size",), 1), EqualTo(("repo",), "r")]))
    assert len(rest) == 2 and [n for p in reader.partitions() for n, _ in p.names] == ["a/deep/notes.txt"]
    whole = FileTreeReader({"root": str(tree), "partition_bytes": "10"})
    assert len(whole.partitions()) > 4 and sum(len(p.names) for p in whole.partitions()) == 9


def test_missing_and_empty_folders(spark, tmp_path):
    assert S.read_tree(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="path not found"):
        S.read_tree(spark, f"{tmp_path}/gone").count()
    assert is_text("x/CLAUDE.md", 10**9) and not is_text("x/notes.md", 10**9) and is_text("q/.cursor/rules/a.md", 10**9) and not is_text("a.png", 1)
    assert FileTree.name() == "file_tree"


def test_resources_without_content(spark, tree):
    skill, _, resources = S.skills(S.read_tree(spark, str(tree), "r"))
    got = {r.resource: r.content for r in resources.where("path = 'r/a'").collect()}
    assert got == {"data.bin": None, ".hidden.md": "hidden", "deep/notes.txt": "notes", "big.md": None}
    off = {r: "off" for r in ("SK106", "SK304")}
    assert skill_rules.skill_hits(skill, skill.select("path").where("false").selectExpr("path", "'' AS link", "true AS exists", "1 AS line"), resources, Config(rules=off)).where("file = 'data.bin'").count() == 0


def test_yaml_that_is_nested_or_aliased_without_bound(spark):
    laughs = "a: &a [x, x, x, x, x, x, x, x, x, x]\n" + "".join(f"{c}: &{c} [{', '.join([f'*{p}'] * 10)}]\n" for p, c in zip("abcdefg", "bcdefgh", strict=True))
    texts = ["a: " + "[" * 600, "a: " + "[" * 5000 + "]" * 5000, laughs, "a: &a [*a]", "a: &x {b: 1}\nc: *x", "{a: " * 3000]
    out = [r.p for r in spark.createDataFrame([(t,) for t in texts], "t string").select(S.parse_yaml("t").alias("p")).collect()]
    assert all(p.json is None and p.error for p in (*out[:4], out[5])) and "aliases" in out[2].error and out[4].json == '{"a": {"b": 1}, "c": {"b": 1}}'


def skill_table(spark):
    row = ("r", "s", "s", "r/s/SKILL.md", True, "text", True, '{"name":"s","description":"My tables"}', None, "text", 1, 1, 1, 1)
    skill = spark.createDataFrame([row], "repo string, path string, name string, skill_file_path string, file_exists boolean, raw string, fm_present boolean, fm_json string, fm_error string, body string, body_start_line int, body_line_count int, tokens_total int, tokens_body int")
    return skill, spark.createDataFrame([], "path string, link string, exists boolean, line int"), spark.createDataFrame([], "path string, resource string, content string")


@pytest.mark.parametrize("broken", ["runs", "builds"])
def test_a_failing_rule_is_named(spark, monkeypatch, broken):
    from pyspark.sql import functions as F

    tables, rules = skill_table(spark), skill_rules.row_rules

    def with_mistake(config):
        bad = hit("x", line=F.raise_error(F.lit("boom"))) if broken == "runs" else hit(F.col("no_such_column"))
        return {**rules(config), "SK105": F.array(bad)}

    few = Config(rules={r: "off" for r in ("SK106", "SK304", "SK401", "SK402", "SK403", "SK404", "SK405", "SK406", "SK101", "SK102", "SK103", "SK201", "SK202", "SK203", "SK204", "SK205", "SK301", "SK302", "SK303")})
    assert {r.rule_id for r in computed_findings(lambda c: skill_rules.skill_hits(*tables, c), "skill", few).collect()} == {"SK105"}
    monkeypatch.setattr(skill_rules, "row_rules", with_mistake)
    with pytest.raises(RuleCrash, match="rule SK105 crashed") as e:
        computed_findings(lambda c: skill_rules.skill_hits(*tables, c), "skill", few)
    assert e.value.rule_id == "SK105"
    assert computed_findings(lambda c: skill_rules.skill_hits(*tables, c), "skill", Config(rules={**few.rules, "SK105": "off"})).count() == 0
