"""Whole gradings: tables in, scorecards out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.operators.context_rules import context_hits
from rubrica.operators.engine import to_findings
from rubrica.operators.mcp_rules import mcp_hits
from rubrica.operators.scoring import rules_run, scorecards
from rubrica.operators.skill_rules import skill_hits
from rubrica.sources.trees import context_files, skills
from rubrica.tables import drop_table, table_of


def artifact_rows(table: DataFrame, artifact_type: str, config: Config, probing: str | None = None) -> DataFrame:
    return table.select(F.lit(artifact_type).alias("artifact_type"), "path", "name", F.col("tokens_total").cast("long").alias("tokens"), (F.coalesce(probing, F.lit(False)) if probing else F.lit(False)).alias("probing"), F.lit(rules_run(artifact_type, config.rules)).alias("rules_run"))


def grade_skills(skill: DataFrame, refs: DataFrame, resources: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return scorecards(artifact_rows(skill, "skill", config), to_findings(skill_hits(skill, refs, resources, config), config))


def grade_servers(servers: DataFrame, tools: DataFrame, probes: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return scorecards(artifact_rows(servers, "mcp-server", config, "probed"), to_findings(mcp_hits(servers, tools, probes, config), config))


def grade_context(ctx: DataFrame, file_refs: DataFrame, command_refs: DataFrame, config: Config | None = None) -> DataFrame:
    config = config or Config()
    return scorecards(artifact_rows(ctx, "context-file", config), to_findings(context_hits(ctx, file_refs, command_refs, config), config))


def findings_of_files(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Findings in all skills and context files of a file table, as a table in the shared folder."""
    return _of_files(files, config or Config(), lambda skill, ctx, c: to_findings(skill_hits(*skill, c).unionByName(context_hits(*ctx, c)), c))


def grade_files(files: DataFrame, config: Config | None = None) -> DataFrame:
    """Scorecards of all skills and context files of a file table of any number of repositories, as a table in the shared folder."""
    return _of_files(files, config or Config(), lambda skill, ctx, c: grade_skills(*skill, c).unionByName(grade_context(*ctx, c)))


def judge_files(files: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(scorecards, findings) of all skills and context files, as tables in the shared folder; the rules run once for both."""
    config = config or Config()
    skill = [table_of(t, "skills") for t in skills(files)]
    ctx = [table_of(t, "contexts") for t in context_files(files)]
    found = table_of(to_findings(skill_hits(*skill, config).unionByName(context_hits(*ctx, config)), config), "findings")
    artifacts = artifact_rows(skill[0], "skill", config).unionByName(artifact_rows(ctx[0], "context-file", config))
    cards = table_of(scorecards(artifacts, found), "cards")
    for t in (*skill, *ctx):
        drop_table(t)
    return cards, found


def judge_servers(servers: DataFrame, tools: DataFrame, probes: DataFrame, config: Config | None = None) -> tuple[DataFrame, DataFrame]:
    """(scorecards, findings) of all servers, as tables in the shared folder."""
    config = config or Config()
    found = table_of(to_findings(mcp_hits(servers, tools, probes, config), config), "findings")
    return table_of(scorecards(artifact_rows(servers, "mcp-server", config, "probed"), found), "cards"), found


def _of_files(files: DataFrame, config: Config, then: Callable[[list[DataFrame], list[DataFrame], Config], DataFrame]) -> DataFrame:
    """then(skill tables, context tables, config). Rules read artifacts many times, so these are tables: parsed once, and no plan holds the parsing and all rules at once."""
    skill = [table_of(t, "skills") for t in skills(files)]
    ctx = [table_of(t, "contexts") for t in context_files(files)]
    out = table_of(then(skill, ctx, config), "graded")
    for t in (*skill, *ctx):
        drop_table(t)
    return out
