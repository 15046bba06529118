"""Command line: python -m rubrica.cli [grade|skill|mcp|repo|ci|badge] ...

Grades print on standard output, what else there is to say on standard error. Exit codes: 0, 1 below the threshold of `ci`, 2 for mistakes of the caller.

What is printed comes to the driver: an artifact's card, or a repository's cards, with their findings. `repo --out` and `mcp --out` write tables of card and finding documents instead, of any size.
"""

from __future__ import annotations

import argparse
import os
import sys
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from rubrica.config import EXIT_BELOW, EXIT_ERROR, EXIT_OK, GRADES, Config, UserError, load_config, parse_rule_flags
from rubrica.operators.engine import sort_key
from rubrica.operators.rollup import gate, worst_grade
from rubrica.plans import reports
from rubrica.plans.grading import judge_files, judge_servers
from rubrica.sources.transcripts import read_transcripts, replay
from rubrica.sources.trees import detect_target, read_tree
from rubrica.tables import drop_table

CONFIG_FILE = "rubrica.config.json"
COMMANDS = ("grade", "skill", "mcp", "repo", "ci", "badge")


class Parser(argparse.ArgumentParser):
    def error(self, message: str) -> None:
        raise UserError(message)


def parser() -> argparse.ArgumentParser:
    shared = Parser(add_help=False)
    shared.add_argument("--format", choices=("terminal", "json", "md"), default="terminal")
    shared.add_argument("--config", help="settings as JSON")
    shared.add_argument("--rules", help="overrides, such as SK101=off,MCP201=warn")
    shared.add_argument("--quiet", action="store_true", help="no findings in terminal output")
    out = Parser(prog=reports.TOOL, description="Grades skills, MCP servers and context files.")
    out.add_argument("--version", action="version", version=reports.VERSION)
    sub = out.add_subparsers(dest="command", required=True, parser_class=Parser)
    add = lambda name, text: sub.add_parser(name, parents=[shared], help=text)
    add("grade", "grade a skill folder, a context file or a repository").add_argument("target", nargs="?", default=".")
    add("skill", "grade a skill folder").add_argument("target")
    mcp = add("mcp", "grade the servers of recorded transcripts")
    mcp.add_argument("target", help="JSON lines of messages")
    mcp.add_argument("--probe", action="store_true", help="judge recorded tool calls too")
    mcp.add_argument("--unsafe", action="store_true", help="also calls of tools that change things")
    mcp.add_argument("--out", help="write card and finding documents here instead of printing")
    repo = add("repo", "grade all skills and context files of a repository")
    repo.add_argument("target", nargs="?", default=".")
    repo.add_argument("--out", help="write card and finding documents here instead of printing")
    ci = add("ci", "grade, and exit with 1 below the threshold")
    ci.add_argument("target", nargs="?", default=".")
    ci.add_argument("--threshold", help="the lowest grade that passes")
    badge = add("badge", "write a badge")
    badge.add_argument("target", nargs="?", default=".")
    badge.add_argument("--out", default=f"{reports.TOOL}-badge.svg")
    return out


def located(target: str, as_repo: bool = False) -> tuple[str, str, str]:
    """(kind, the folder to read, the artifact's path in it). A URI is a repository."""
    if "://" in target:
        return "repo", target.rstrip("/"), ""
    kind, path = detect_target(target)
    full = os.path.abspath(path)
    if as_repo and not os.path.isdir(target):
        raise UserError(f"{target} is not a folder")
    if as_repo or kind != "context-file":
        return "repo" if as_repo else kind, full, ""
    folder, name = os.path.split(full)
    if folder.split(os.sep)[-2:] == [".cursor", "rules"]:  # these are told by their folder
        return kind, os.path.dirname(os.path.dirname(folder)), f".cursor/rules/{name}"
    return kind, folder, name


def of_target(spark: SparkSession, target: str, config: Config, as_repo: bool = False) -> tuple[str, DataFrame, DataFrame]:
    """(kind, cards, findings) of a skill, a context file or a repository, as tables; paths are within the repository, or the target itself."""
    kind, root, name = located(target, as_repo)
    cards, found = judge_files(read_tree(spark, root, root, config.ignore), config)
    if kind == "repo":
        path = F.when(F.col("path") == root, ".").otherwise(F.substring("path", len(root) + 2, 1 << 30))
        return kind, cards.withColumn("path", path), found.withColumn("path", path)
    own = (F.col("artifact_type") == kind) & (F.col("path") == (f"{root}/{name}" if name else root))
    return kind, cards.where(own).withColumn("path", F.lit(target)), found.where(own).withColumn("path", F.lit(target))


def card_text(card: Row, findings: list[Row], options: argparse.Namespace) -> str:
    own = [f for f in findings if (f.artifact_type, f.path) == (card.artifact_type, card.path)]
    if options.format == "json":
        return reports.card_json(card, own)
    return reports.markdown(card, own) if options.format == "md" else reports.terminal(card, own, options.quiet)


def text_of(kind: str, cards: list[Row], findings: list[Row], options: argparse.Namespace) -> str:
    if kind != "repo":
        return "\n".join(card_text(c, findings, options) for c in cards)
    if options.format == "json":
        return reports.repo_json(cards, findings)
    return reports.repo_markdown(cards) if options.format == "md" else reports.repo_terminal(cards)


def told(kind: str, cards: DataFrame, found: DataFrame, options: argparse.Namespace) -> None:
    """Prints, or writes card and finding documents as two tables of JSON lines."""
    if getattr(options, "out", None):
        reports.card_documents(cards).write.json(f"{options.out.rstrip('/')}/cards")
        reports.finding_documents(found).write.json(f"{options.out.rstrip('/')}/findings")
    else:
        print(text_of(kind, cards.collect(), found.orderBy("path", sort_key()).collect(), options))


def grade_target(spark: SparkSession, options: argparse.Namespace, config: Config) -> int:
    if options.command == "skill" and located(options.target)[0] != "skill":
        raise UserError(f"no SKILL.md in {options.target}")
    limit = getattr(options, "threshold", None) or config.threshold
    if limit not in GRADES:
        raise UserError(f'invalid threshold "{limit}": expected one of {" ".join(GRADES)}')
    kind, cards, found = of_target(spark, options.target, config, options.command == "repo")
    try:
        overall = worst_grade(cards).first()
        if overall.overall is None:
            raise UserError(f"no skills or context files found under {options.target}")
        if options.command == "badge":
            with open(options.out, "w", encoding="utf-8") as f:
                f.write(reports.badge(overall.overall))
            print(f"wrote {options.out} (grade {overall.overall})", file=sys.stderr)
            print(f"![{reports.TOOL}]({options.out})")
            return EXIT_OK
        told(kind, cards, found, options)
        return gated(cards, overall.overall, limit) if options.command == "ci" else EXIT_OK
    finally:
        drop_table(cards)
        drop_table(found)


def gated(cards: DataFrame, overall: str, limit: str) -> int:
    """The verdict on standard error, so that printed JSON stays JSON."""
    failed = gate(cards, limit).select("path", "grade").orderBy("path").collect()
    for c in failed:
        print(f"✗ {c.path}: {c.grade} is below threshold {limit}", file=sys.stderr)
    print(f"✗ ci gate failed (threshold {limit})" if failed else f"✓ ci gate: {overall} meets threshold {limit}", file=sys.stderr)
    return EXIT_BELOW if failed else EXIT_OK


def grade_transcripts(spark: SparkSession, options: argparse.Namespace, config: Config) -> int:
    """Servers that were reached; those that weren't are mistakes, named with a hint."""
    r = replay(read_transcripts(spark, options.target), config, options.probe, options.unsafe)
    cards, found = judge_servers(r.servers, r.tools, r.probes, config)
    try:
        if options.probe and (skipped := reports.skipped_probes(r.probes).orderBy("path", "tool_name").collect()):
            print(f"probe: skipped {len(skipped)} of {r.probes.count()} tools (pass --unsafe to judge calls of tools that change things):", file=sys.stderr)
            for s in skipped:
                print(f"  - {s.tool_name}  ({s.skip_reason})", file=sys.stderr)
        told("mcp-server", cards, found, options)
        lost = r.unreachable.orderBy("path").collect()
        for u in lost:
            print(f"{u.error}\n  {u.hint}", file=sys.stderr)
        return EXIT_ERROR if lost else EXIT_OK
    finally:
        for t in (cards, found, r.exchanges):
            drop_table(t)


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Runs one command and returns its exit code."""
    own = list(sys.argv[1:] if argv is None else argv)
    if not own or (own[0] not in COMMANDS and own[0] not in ("-h", "--help", "--version")):
        own.insert(0, "grade")
    try:
        options = parser().parse_args(own)
        config = load_config(options.config, CONFIG_FILE)
        config = replace(config, rules=config.rules | parse_rule_flags(options.rules))
        session = spark or SparkSession.builder.appName(reports.TOOL).getOrCreate()
        return (grade_transcripts if options.command == "mcp" else grade_target)(session, options, config)
    except UserError as e:
        print(f"error: {e}", file=sys.stderr)
        return EXIT_ERROR


if __name__ == "__main__":
    sys.exit(main())
