"""The rule catalogue as data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RuleMeta:
    id: str
    title: str
    severity: str
    dimension: str
    applies_to: str
    fix: str
    security_cap: bool = False
    multiplier: float = 1.0


# Ids, titles, severities, dimensions and fix hints.
_ROWS = """
SK001|SKILL.md missing or unreadable|error|structure|Create a SKILL.md with YAML frontmatter (name, description) at the skill root.
SK002|Frontmatter missing, invalid, or incomplete|error|structure|Start SKILL.md with a YAML frontmatter block declaring name and description.
SK003|Skill name malformed or mismatched|warn|structure|Rename the skill to a kebab-case name (max 64 chars) that matches its directory.
SK004|Unknown frontmatter keys|info|structure|Confirm the key is meaningful to your host, or remove it.
SK005|Dead relative link|warn|structure|Fix the link target or add the missing companion file.
SK006|Absolute local filesystem path|warn|structure|Replace the absolute path with a path relative to the skill directory.
SK101|Description too short or placeholder|error|trigger|Write a real description: what the skill does and when to use it.
SK102|Description too long|warn|trigger|Trim the description to the essentials; move detail into the body.
SK103|No usage guidance in description|warn|trigger|Add a "Use when …" clause describing the requests that should route here.
SK104|Description lacks concrete action verbs|warn|trigger|Name the concrete operations the skill performs (e.g. "extract, convert, validate").
SK105|First-person description|info|trigger|Rewrite the description in third person ("Converts…", not "I can convert…").
SK106|Description collides with a sibling skill|warn|trigger|Differentiate the two descriptions or merge the overlapping skills.
SK201|Body approaching token budget|info|token|Move reference detail into companion files loaded on demand.
SK202|Body over token budget|warn|token|Split the body: keep the workflow in SKILL.md, push detail to linked files.
SK203|Monolithic body with no companion files|warn|token|Extract reference material into companion files and link them from the body.
SK204|Oversized inline code block|info|token|Move the code block into a companion script or reference file.
SK205|Section teaches what the model already knows|warn|token|Delete the tutorial section — the model already knows the basics.
SK301|No step structure|warn|instruction|Restructure the workflow as numbered steps with imperative verbs.
SK302|No verification step|info|instruction|Add a step that verifies the output before declaring success.
SK303|No failure-path guidance|info|instruction|Describe what to do when a step fails (fallback, error handling, escalation).
SK304|Contradictory absolute modifiers|warn|instruction|Resolve the contradiction: keep one rule or scope each to its context.
SK401|Prompt-injection phrasing|error|security|Remove the instruction — skills must never override the host or hide from the user.
SK402|Hidden or obfuscating Unicode|error|security|Delete the invisible characters — legitimate instructions never need them.
SK403|Secret-shaped string|error|security|Remove the credential and rotate it; reference secrets via environment variables.
SK404|Fetch-and-execute instruction|warn|security|Pin and ship the script with the skill instead of piping a download into a shell.
SK405|Base64 blob in instructions|warn|security|Replace the encoded blob with plaintext content or a reviewable companion file.
SK406|Link to non-major external domain|info|security|Confirm the domain is intentional and trustworthy before shipping the skill.
MCP001|Server fails MCP initialization|error|protocol|Make the server complete the MCP initialize handshake before anything else.
MCP002|tools/list fails or returns malformed entries|error|protocol|Return spec-shaped tool entries (non-empty string name, object inputSchema) from tools/list.
MCP003|Protocol version or capabilities incomplete|warn|protocol|Report a protocol version and a non-empty capabilities object during initialize.
MCP004|Deprecated SSE transport endpoint|info|protocol|Migrate the endpoint to the streamable HTTP transport (spec 2025-03-26 or later).
MCP101|Tool has no description|error|definition|Write a description stating what the tool does and when the model should call it.
MCP102|Tool description too short or generic|warn|definition|Describe what the tool does and when to use it, not just restate its name.
MCP103|Input schema empty while description implies parameters|error|definition|Declare the implied parameters as properties of a type:"object" inputSchema.
MCP104|Parameters missing descriptions|warn|definition|Add a description to every schema property saying what the value means and its format.
MCP105|Enum described in prose instead of schema|warn|definition|Move the allowed values from the description prose into an enum array on the property.
MCP106|No required array despite mandatory-sounding parameters|warn|definition|List the mandatory parameters in the schema "required" array.
MCP107|Tool name style, length, or collision|info|definition|Use short snake_case or kebab-case names that stay distinct after normalization.
MCP108|Too many tools for reliable selection|warn|definition|Split the catalog into focused servers or namespace tools behind fewer entry points.
MCP201|Per-tool token cost over budget|info|token|Trim the description and schema to what the model needs to choose and call the tool.
MCP202|Total server context tax over budget|warn|token|Cut catalog size: shorter descriptions, leaner schemas, fewer always-on tools.
MCP203|Verbose JSON-Schema anti-patterns|info|token|Flatten nested anyOf/oneOf unions and drop titles that repeat the property name.
MCP301|Injection phrases in tool metadata|error|security|Delete the instruction-to-the-model from the tool metadata — descriptions document, they do not command.
MCP302|Hidden Unicode in tool metadata|error|security|Delete the invisible characters — legitimate tool metadata never needs them.
MCP303|Cross-tool steering in description|warn|security|Describe what the tool does; let the host decide tool ordering.
MCP304|References credential files or secrets stores|warn|security|Remove references to key and credential material the tool has no business touching.
MCP305|Tool name near a well-known tool (typosquat surface)|info|security|Rename the tool so it is clearly distinct from well-known tools and its siblings.
MCP401|Tool call fails at the protocol level|warn|reliability|Handle any input the advertised inputSchema admits; report tool failures as an isError result, never a protocol error.
MCP402|Probe p95 latency over budget|info|reliability|Cut cold-start and per-call overhead, or raise budgets.probeLatencyP95Ms if slow calls are inherent to the domain.
MCP403|Error responses lack machine-readable structure|warn|reliability|Return errors as structured content (e.g. a JSON body with a code and message) instead of a bare prose or stack-trace string.
CTX001|Context file exceeds its token budget|info|quality|Trim the file to durable project-specific facts and move reference material into linked docs.
CTX002|References files that do not exist|warn|quality|Update the path to the file’s current location or delete the stale reference.
CTX003|References commands the project does not define|warn|quality|Fix the command name or add the missing script to the project manifest.
CTX004|Contradictory absolute rules|warn|quality|Keep whichever rule is correct and delete the contradicting one.
CTX005|Generic filler sections|info|quality|Delete the section — the model already knows this background.
CTX006|Injection phrases, hidden Unicode, or secrets|error|quality|Remove the injected instruction, hidden character, or secret from the file.
"""
SECURITY_CAPPED = {"SK401", "SK402", "SK403", "MCP301", "MCP302", "CTX006"}
TYPES = {"SK": "skill", "MCP": "mcp-server", "CTX": "context-file"}

RULES: dict[str, RuleMeta] = {}
for _line in _ROWS.strip().splitlines():
    _id, _title, _sev, _dim, _fix = _line.split("|")
    RULES[_id] = RuleMeta(_id, _title, _sev, _dim, TYPES[_id.rstrip("0123456789")], _fix, _id in SECURITY_CAPPED, 2.0 if _id == "CTX006" else 1.0)

META_SCHEMA = "rule_id string, title string, severity string, dimension string, artifact_type string, fix string, security_cap boolean, multiplier double"


def rule_meta(spark: SparkSession, rules: dict[str, RuleMeta] | None = None) -> DataFrame:
    """One row per rule; a fixed, small table."""
    return spark.createDataFrame([(r.id, r.title, r.severity, r.dimension, r.applies_to, r.fix, r.security_cap, r.multiplier) for r in (rules or RULES).values()], META_SCHEMA)


def active(artifact_type: str, overrides: dict[str, str]) -> list[str]:
    """Rules that run for an artifact type; a rule that is off isn't built into the plan."""
    return [r.id for r in RULES.values() if r.applies_to == artifact_type and overrides.get(r.id) != "off"]
