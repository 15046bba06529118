"""Configuration: budgets, grade bands, weights and overrides."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

# Penalties, decay, bands, caps and weights.
PENALTY = {"error": 15.0, "warn": 5.0, "info": 1.0}
DECAY = (1.0, 0.5, 0.25)
DECAY_TAIL = 0.1
BANDS = [(97, "A+"), (93, "A"), (90, "A-"), (87, "B+"), (83, "B"), (80, "B-"), (77, "C+"), (73, "C"), (70, "C-"), (60, "D")]
GRADES = [g for _, g in BANDS] + ["F"]
SECURITY_CAP, FOUNDATIONAL_CAP = 79, 55
WEIGHTS = {
    "skill": {"structure": 0.15, "trigger": 0.3, "token": 0.2, "instruction": 0.15, "security": 0.2},
    "mcp-server": {"protocol": 0.2, "definition": 0.3, "token": 0.2, "security": 0.3},
    "context-file": {"quality": 1.0},
}
PROBE_WEIGHTS = {"protocol": 0.2, "definition": 0.2, "token": 0.2, "security": 0.3, "reliability": 0.1}
LABELS = {
    "structure": "Structure",
    "trigger": "Trigger quality",
    "token": "Token efficiency",
    "instruction": "Instruction quality",
    "security": "Security",
    "protocol": "Protocol compliance",
    "definition": "Definition quality",
    "reliability": "Reliability",
    "quality": "Quality",
}
EXIT_OK, EXIT_BELOW, EXIT_ERROR = 0, 1, 2


class UserError(ValueError):
    """A mistake of the caller: shown without a trace, exit code 2."""


@dataclass(frozen=True)
class Budgets:
    # Default budgets.
    descriptionMinChars: float = 20
    descriptionMaxChars: float = 1024
    skillBodyTokensInfo: float = 2000
    skillBodyTokensWarn: float = 5000
    skillBodyMaxLines: float = 300
    skillCodeBlockMaxLines: float = 80
    similarityJaccard: float = 0.6
    base64MinLength: int = 200
    mcpConnectTimeoutMs: float = 15_000
    mcpToolTokensInfo: float = 400
    mcpToolTokensWarn: float = 800
    mcpServerTokensWarn: float = 8000
    mcpMaxTools: float = 30
    probeLatencyP95Ms: float = 5000
    ctxTokensInfo: float = 1500
    ctxTokensWarn: float = 4000


@dataclass(frozen=True)
class Config:
    budgets: Budgets = Budgets()
    rules: dict[str, str] = field(default_factory=dict)  # rule id: error, warn, info or off
    threshold: str = "B"
    ignore: tuple[str, ...] = ()


TOP_KEYS = {"rules", "budgets", "threshold", "ignore", "eval"}


def parse_rule_flags(flag: str | None) -> dict[str, str]:
    """ "SK101=off,MCP201=warn" as overrides."""
    out = {}
    for part in filter(None, (x.strip() for x in (flag or "").split(","))):
        rule, eq, severity = (x.strip() for x in part.partition("="))
        if not eq or not rule or severity not in ("error", "warn", "info", "off"):
            raise UserError(f'bad rule override "{part}": expected ID=error|warn|info|off')
        out[rule.upper()] = severity
    return out


def load_config(path: str | None, default: str = "", rule_flags: str | None = None) -> Config:
    """Settings from a JSON file over the defaults; a file that wasn't named may be missing; flags win."""
    where = Path(path or default) if (path or default) else None
    raw: dict = {}
    if where is not None and (path or where.exists()):
        if not where.exists():
            raise UserError(f"config file not found: {where}")
        try:
            raw = json.loads(where.read_text())
        except ValueError as e:
            raise UserError(f"config file is not valid JSON: {where}") from e
        if not isinstance(raw, dict) or set(raw) - TOP_KEYS:
            raise UserError(f"unknown config keys: {sorted(set(raw) - TOP_KEYS) if isinstance(raw, dict) else raw}")
    budgets = raw.get("budgets", {})
    if set(budgets) - {f.name for f in fields(Budgets)}:
        raise UserError(f"unknown budgets: {sorted(set(budgets) - {f.name for f in fields(Budgets)})}")
    threshold = raw.get("threshold", "B")
    if threshold not in GRADES:
        raise UserError(f'unknown grade "{threshold}"')
    rules = {k.upper(): v for k, v in raw.get("rules", {}).items()}
    return Config(replace(Budgets(), **budgets), rules | parse_rule_flags(rule_flags), threshold, tuple(raw.get("ignore", ())))
