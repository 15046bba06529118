"""Scorecards as JSON, Markdown, terminal text and badges. One card or one repository's cards are rendered on the driver; tables stay tables."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from rubrica.config import GRADES, LABELS, WEIGHTS
from rubrica.operators.catalog import RULES

TOOL = "rubrica"
# Widths of grade texts and colours of grades on a badge, in pixels and hex.
GRADE_WIDTHS = {"A+": 16, "A": 8, "A-": 12, "B+": 17, "B": 8, "B-": 12, "C+": 17, "C": 8, "C-": 13, "D": 8, "F": 7}
GRADE_COLOURS = {"A": "#4c1", "B+": "#97ca00", "B": "#97ca00", "B-": "#a4a61d", "C": "#dfb317", "D": "#fe7d37", "F": "#e05d44"}
WIDTH, SLOTS = 78, 20
GLYPHS = {"error": "✖", "warn": "▲", "info": "ℹ"}
PATH_WIDTH, REPO_WIDTH = 48, 110
SCHEMA_VERSION = 1
# What a card's JSON holds. A name with ? may be missing; a list is an array of its entry; a tuple lists the values there are.
NUMBER = int | float
SEVERITY = tuple(GLYPHS)
FINDING_SHAPE = {"ruleId": str, "severity": SEVERITY, "dimension": tuple(LABELS), "message": str, "fix": str, "foundational?": bool, "location?": {"file?": str, "line?": int, "toolName?": str}, "meta?": dict}
CARD_SHAPE = {
    "schemaVersion": (SCHEMA_VERSION,),
    "toolVersion": str,
    "deterministic": bool,
    "artifact": {"type": tuple(WEIGHTS), "name": str, "path": str},
    "dimensions": [{"dimension": tuple(LABELS), "label": str, "score": NUMBER, "grade": tuple(GRADES), "weight": NUMBER, "findings": [FINDING_SHAPE]}],
    "composite": NUMBER,
    "compositeRaw": NUMBER,
    "grade": tuple(GRADES),
    "securityCapped": bool,
    "foundationalCapped": bool,
    "topFixes": [{"ruleId": str, "severity": SEVERITY, "dimension": tuple(LABELS), "message": str, "fix": str, "count": int, "gain": NUMBER, "projectedComposite": NUMBER, "projectedGrade": tuple(GRADES)}],
    "stats": {"tokens": int, "rulesRun": int, "findings": {"error": int, "warn": int, "info": int}},
}
NAMES = {str: "string", bool: "boolean", dict: "object", int: "whole number", NUMBER: "number"}


VERSION = "0.3.0"


def card_documents(cards: DataFrame) -> DataFrame:
    """(path, card): each scorecard as a JSON document. How many findings a dimension has is in it; they themselves are documents of their own, so an artifact with very many makes no row of that size."""
    c = F.col
    # Casts to structs of other names: a transform would rebuild each struct outside generated code
    dims = c("dimensions").cast("array<struct<dimension: string, label: string, score: double, grade: string, weight: double, findingCount: bigint>>")
    fixes = c("top_fixes").cast("array<struct<ruleId: string, severity: string, dimension: string, message: string, fix: string, count: bigint, gain: double, projectedComposite: double, projectedGrade: string>>")
    stats = F.struct("tokens", c("rules_run").alias("rulesRun"), F.struct(c("n_error").alias("error"), c("n_warn").alias("warn"), c("n_info").alias("info")).alias("findings"))
    card = F.struct(
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        F.lit(VERSION).alias("toolVersion"),
        F.lit(True).alias("deterministic"),
        F.struct(c("artifact_type").alias("type"), "name", "path").alias("artifact"),
        dims.alias("dimensions"),
        "composite",
        c("composite_raw").alias("compositeRaw"),
        "grade",
        c("security_capped").alias("securityCapped"),
        c("foundational_capped").alias("foundationalCapped"),
        fixes.alias("topFixes"),
        stats.alias("stats"),
    )
    return cards.select("path", F.to_json(card).alias("card"))


def finding_documents(findings: DataFrame) -> DataFrame:
    """(path, finding): each finding as a JSON document; what is null is left out."""
    at = F.when(F.coalesce("file", F.col("line").cast("string"), "tool_name").isNotNull(), F.struct("file", "line", F.col("tool_name").alias("toolName")))
    doc = F.struct(F.col("rule_id").alias("ruleId"), "severity", "dimension", "message", "fix", F.when(F.col("foundational"), F.lit(True)).alias("foundational"), at.alias("location"), "meta")
    return findings.select("path", F.to_json(doc).alias("finding"))


def without_nulls(**fields: object) -> dict:
    return {k: v for k, v in fields.items() if v is not None}


def finding_shape(f: Row) -> dict:
    location = without_nulls(file=f.file, line=f.line, toolName=f.tool_name)
    return without_nulls(ruleId=f.rule_id, severity=f.severity, dimension=f.dimension, message=f.message, fix=f.fix, foundational=f.foundational or None, location=location or None, meta=f.meta)


def card_shape(card: Row, findings: Iterable[Row] = ()) -> dict:
    """A card with its findings as the document that readers are promised, checked."""
    own = list(findings)
    doc = {
        "schemaVersion": SCHEMA_VERSION,
        "toolVersion": VERSION,
        "deterministic": True,
        "artifact": {"type": card.artifact_type, "name": card.name, "path": card.path},
        "dimensions": [{"dimension": d.dimension, "label": d.label, "score": d.score, "grade": d.grade, "weight": d.weight, "findings": [finding_shape(f) for f in own if f.dimension == d.dimension]} for d in card.dimensions],
        "composite": card.composite,
        "compositeRaw": card.composite_raw,
        "grade": card.grade,
        "securityCapped": card.security_capped,
        "foundationalCapped": card.foundational_capped,
        "topFixes": [{"ruleId": x.rule_id, "severity": x.severity, "dimension": x.dimension, "message": x.message, "fix": x.fix, "count": x["count"], "gain": x.gain, "projectedComposite": x.projected_composite, "projectedGrade": x.projected_grade} for x in card.top_fixes or ()],
        "stats": {"tokens": card.tokens, "rulesRun": card.rules_run, "findings": {"error": card.n_error, "warn": card.n_warn, "info": card.n_info}},
    }
    return checked(doc)


def checked(value: object, shape: object = None, at: str = "card") -> object:
    """The value without fields that its shape doesn't have; ValueError, with the place, where it departs from the shape."""
    shape = CARD_SHAPE if shape is None else shape
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            raise ValueError(f"{at} is not an object")
        gone = [k for k in shape if not k.endswith("?") and k not in value]
        if gone:
            raise ValueError(f"{at}.{gone[0]} is missing")
        return {k.rstrip("?"): checked(value[k.rstrip("?")], s, f"{at}.{k.rstrip('?')}") for k, s in shape.items() if k.rstrip("?") in value}
    if isinstance(shape, list):
        if not isinstance(value, list):
            raise ValueError(f"{at} is not an array")
        return [checked(x, shape[0], f"{at}[{i}]") for i, x in enumerate(value)]
    if isinstance(shape, tuple):
        if value not in shape or isinstance(value, bool) != isinstance(shape[0], bool):
            raise ValueError(f"{at} is not one of {', '.join(map(str, shape))}")
        return value
    if not isinstance(value, shape) if shape is bool or shape is str or shape is dict else isinstance(value, bool) or not isinstance(value, shape):
        raise ValueError(f"{at} is not a {NAMES[shape]}")
    return value


def card_json(card: Row, findings: Iterable[Row] = ()) -> str:
    return json.dumps(card_shape(card, findings), indent=2, ensure_ascii=False)


def number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else f"{x:.1f}"


def half_up(x: float) -> int:
    return int(x + 0.5)


def cell(text: str) -> str:
    return text.replace("|", "\\|").replace("\r\n", " ").replace("\n", " ")


def place(f: Row) -> str:
    if f.tool_name:
        return f"`{cell(f.tool_name)}`"
    if f.file:
        return f"`{cell(f.file)}{'' if f.line is None else f':{f.line}'}`"
    return "—" if f.line is None else f"line {f.line}"


def by_dimension(card: Row, findings: Iterable[Row]) -> list[Row]:
    """Findings of weighted dimensions, in the card's order."""
    own = list(findings)
    return [f for d in card.dimensions for f in own if f.dimension == d.dimension]


def markdown(card: Row, findings: Iterable[Row] = (), previous: str | None = None) -> str:
    """A card with its findings in their total order; previous: the grade to compare with."""
    out = [f"## {TOOL}: {card.grade} ({number(card.composite)}) — {card.artifact_type} `{card.path}`", ""]
    if previous is not None:
        out += [f"**Grade:** {card.grade} (unchanged)" if previous == card.grade else f"**Grade:** {previous} → {card.grade}", ""]
    if card.security_capped:
        out += [f"> **Security cap applied.** Error-level security findings pin the grade at C+; the score would be {number(card.composite_raw)}.", ""]
    if card.foundational_capped:
        out += [f"> **Foundational failure.** The artifact cannot load, so the grade is F; the rules that could run scored {number(card.composite_raw)}.", ""]
    out += ["| Dimension | Score | Grade | Issues |", "| --- | ---: | :---: | ---: |"]
    out += [f"| {cell(d.label)} | {half_up(d.score)} | {d.grade} | {d.findings} |" for d in card.dimensions]
    if card.top_fixes:
        out += ["", "### Top fixes", ""]
        out += [f"{i}. **{x.rule_id}**{f' ×{x['count']}' if x['count'] > 1 else ''} — {x.fix} (+{number(x.gain)} → {x.projected_grade} {number(x.projected_composite)})" for i, x in enumerate(card.top_fixes, 1)]
    if shown := by_dimension(card, findings):
        out += ["", "### Findings", "", "| Severity | Rule | Message | Location |", "| --- | --- | --- | --- |"]
        out += [f"| {f.severity} | {f.rule_id} | {cell(f.message)} | {place(f)} |" for f in shown]
    return "\n".join([*out, "", "---", "", f"{TOOL} · {card.rules_run} rules run · ~{card.tokens:,} tokens", ""])


def terminal(card: Row, findings: Iterable[Row] = (), quiet: bool = False) -> str:
    """A card in 80 columns, without colour."""
    right = f"{card.artifact_type} · {card.path}"
    out = ["", f"  {TOOL.upper()}{' ' * max(1, WIDTH - len(TOOL) - len(right))}{right}", ""]
    for d in card.dimensions:
        full = half_up(d.score / 100 * SLOTS)
        issues = f"   {d.findings} issue{'' if d.findings == 1 else 's'}" if d.findings else ""
        out.append(f"  {d.label:<20}{'█' * full}{'░' * (SLOTS - full)}  {half_up(d.score):>3}  {d.grade:<2}{issues}")
    head = f"── Grade: {card.grade} ({half_up(card.composite)}) "
    out += ["", f"  {head}{'─' * max(0, WIDTH - len(head))}"]
    if card.security_capped:
        out.append(f"  ▲ security errors cap the grade at C+ (uncapped: {half_up(card.composite_raw)})")
    if card.foundational_capped:
        out.append(f"  ▲ artifact cannot load — grade pinned to F (rules that could run scored: {half_up(card.composite_raw)})")

    def fit(text: str, used: int) -> str:
        room = WIDTH + 2 - used
        return text if len(text) <= room else f"{text[: max(0, room - 1)]}…"

    if card.top_fixes:
        out += ["", f"  Top fixes → {card.top_fixes[0].projected_grade}"]
        for i, x in enumerate(card.top_fixes, 1):
            gain, count = f"(+{half_up(x.gain)})", f" ×{x['count']}" if x["count"] > 1 else ""
            out.append(f"   {i}. {x.rule_id}{count}  {fit(x.fix, 8 + len(x.rule_id) + len(count) + len(gain) + 2)}  {gain}")
    shown = by_dimension(card, findings)
    if shown and not quiet:
        out += ["", "  Findings"]
        for f in shown:
            where = f.tool_name or (f"{f.file}{f':{f.line}' if f.line else ''}" if f.file else "")
            out.append(f"   {GLYPHS[f.severity]} {f.rule_id}  {fit(f.message, 7 + len(f.rule_id) + (len(where) + 2 if where else 0))}{'  ' + where if where else ''}")
    return "\n".join([*out, "", f"  {card.rules_run} rules · {len(shown)} finding{'' if len(shown) == 1 else 's'} · ~{card.tokens} tokens", ""])


def badge(grade: str) -> str:
    """A flat SVG badge; the same bytes for the same grade."""
    if grade not in GRADES:
        raise ValueError(grade)
    left, right = 6 * len(TOOL) + 10, GRADE_WIDTHS[grade] + 10
    colour = GRADE_COLOURS.get(grade, GRADE_COLOURS[grade[0]])
    label, value = left * 5, left * 10 + right * 5
    text = lambda x, n, t: f'<text x="{x}" y="140" transform="scale(.1)" textLength="{n}">{t}</text>'
    return (
        f'<svg xmlns="http://www.w3.org/2000/svg" width="{left + right}" height="20" role="img" aria-label="{TOOL}: {grade}"><title>{TOOL}: {grade}</title>'
        f'<clipPath id="r"><rect width="{left + right}" height="20" rx="3" fill="#fff"/></clipPath><g clip-path="url(#r)"><rect width="{left}" height="20" fill="#555"/><rect x="{left}" width="{right}" height="20" fill="{colour}"/></g>'
        f'<g fill="#fff" text-anchor="middle" font-family="Verdana,Geneva,DejaVu Sans,sans-serif" font-size="110">{text(label, (left - 10) * 10, TOOL)}{text(value, GRADE_WIDTHS[grade] * 10, grade)}</g></svg>'
    )


def overall_grade(cards: list[Row]) -> str:
    """The weakest artifact's grade."""
    return max((c.grade for c in cards), key=GRADES.index)


def in_order(cards: list[Row]) -> list[Row]:
    """Skills first, then context files, by path."""
    return sorted(cards, key=lambda c: (list(WEIGHTS).index(c.artifact_type), c.path))


def offender(card: Row, mark: str = "") -> str:
    return f"{mark}{card.top_fixes[0].rule_id}{mark} {card.top_fixes[0].fix}" if card.top_fixes else "—"


def repo_markdown(cards: list[Row]) -> str:
    """A repository's cards; the weakest decides."""
    out = [f"## {TOOL} repo scorecard — overall **{overall_grade(cards)}**", "", "| Artifact | Type | Grade | Score | Worst offender |", "| --- | --- | --- | ---: | --- |"]
    out += [f"| {c.path} | {c.artifact_type} | **{c.grade}** | {half_up(c.composite)} | {offender(c, '`')} |" for c in in_order(cards)]
    return "\n".join([*out, "", "_The weakest artifact gates the repo._"])


def repo_terminal(cards: list[Row]) -> str:
    """A repository's cards as a table without colour; the lowest scores are marked, long rows cut."""
    lowest, wide = min(c.composite for c in cards), min(PATH_WIDTH, max(8, *(len(c.path) for c in cards)))
    out = ["", f"  {'ARTIFACT':<{wide}}  {'TYPE':<12} GRADE  SCORE  WORST OFFENDER"]
    for c in in_order(cards):
        mark = "▸ " if c.composite == lowest and len(cards) > 1 else "  "
        line = f"{mark}{c.path:<{wide}}  {c.artifact_type:<12} {c.grade:<5}  {half_up(c.composite):>3}   {offender(c)}"
        out.append(line if len(line) <= REPO_WIDTH else f"{line[: REPO_WIDTH - 3]}…")
    return "\n".join([*out, "", f"  Overall: {overall_grade(cards)} · {len(cards)} artifact{'' if len(cards) == 1 else 's'} · the weakest artifact gates the repo", ""])


def repo_json(cards: list[Row], findings: Iterable[Row] = ()) -> str:
    own: dict[tuple[str, str], list[Row]] = {}
    for f in findings:
        own.setdefault((f.artifact_type, f.path), []).append(f)
    shapes = [card_shape(c, own.get((c.artifact_type, c.path), ())) for c in in_order(cards)]
    return json.dumps({"schemaVersion": SCHEMA_VERSION, "overall": overall_grade(cards), "artifacts": shapes}, indent=2, ensure_ascii=False)


def rules_document() -> str:
    """The rule catalogue by artifact type, dimension and id."""
    out: list[str] = []
    last: tuple[str, str] | None = None
    for r in sorted(RULES.values(), key=lambda r: (r.applies_to, r.dimension, r.id)):
        if (r.applies_to, r.dimension) != last:
            last = (r.applies_to, r.dimension)
            out += ["", f"## {r.applies_to}: {r.dimension}", "", "| Rule | Severity | Title | Fix |", "| --- | --- | --- | --- |"]
        out.append(f"| {r.id} | {r.severity}{', caps' if r.security_cap else ''} | {cell(r.title)} | {cell(r.fix)} |")
    return "\n".join(["# Rules", *out, ""])


def skipped_probes(probes: DataFrame) -> DataFrame:
    """Tools that weren't probed, and why."""
    return probes.where("skipped").select("path", "tool_name", "skip_reason")
