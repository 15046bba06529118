"""Rules for skill packages.

skill: repo, path, name, skill_file_path, file_exists, raw, fm_present, fm_json, fm_error, body, body_start_line, body_line_count, tokens_total,
tokens_body. skill_ref: path, link, exists, line. skill_resource: path, resource, content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.functions import detectors as D
from rubrica.functions.text import SPACE_IN_CLASS, fenced_blocks, filled_lines, let, matches, mostly_english, regex, trimmed, utf16_length, word_count, word_set
from rubrica.operators.catalog import active
from rubrica.operators.hits import built_once, by_row, hit, none, rows, text, when
from rubrica.operators.joins import alike_sets, opposed
from rubrica.tables import spread, unsent

TYPE = "skill"
FILE = "SKILL.md"

# Lexicons and limits of the rules.
KNOWN_KEYS = ["name", "description", "version", "license", "metadata", "allowed-tools", "compatibility"]
MAX_NAME = 64
KEBAB = "^[a-z0-9]+(-[a-z0-9]+)*$"
ABSOLUTE_PATH = regex(r"/(?:Users|home|var|etc|tmp|opt)/[^\s\"'`)\],;]+|\b[A-Za-z]:\\[^\s\"'`)\],;]+")
#: What each absolute path has one of.
ABSOLUTE_PATH_WORDS = ("/Users/", "/home/", "/var/", "/etc/", "/tmp/", "/opt/", ":\\")
PLACEHOLDERS = [regex(p, "i") for p in (r"^(?:todo|tbd|fixme|xxx)\b", r"^description (?:goes )?here\b", r"^does stuff\b", r"^a skill(?: for [\w\s-]{0,24})?[.!]?$")]
USAGE = regex(r"\buse\s+when\b|\buse\s+this\b|\btrigger\b|\bfor\s+tasks\b|\binvoke\s+when\b|\bapplies\s+when\b|\bwhen\s+the\s+user\b", "i")
VERBS = "analyze annotate archive audit build classify clean compile compress configure convert copy create debug decode decrypt delete deploy diff download edit encode encrypt export extract fetch fill filter flatten format generate import index inspect install lint list merge migrate monitor optimize parse patch plot publish query read redact refactor rename render resize run scan schedule scrape search send sign sort split summarize sync transcribe transform translate update upload validate verify write".split()
FIRST_PERSON = regex(r"\bI\s+(?:can|will|help|am)\b|\bmy\b", "i")
MIN_WORDS = 7
TECH = r"(?:git|python|bash|node(?:\.js)?|nodejs|npm|javascript|typescript|docker|react|linux|sql|html|css|json|yaml)"
BOILERPLATE = "|".join(regex(p) for p in (rf"^what is {TECH}\b", rf"^how {TECH} works\b", rf"^intro(?:duction)? to {TECH}\b", rf"^{TECH} basics\b", rf"^installing {TECH}\b", rf"^how to install {TECH}\b", rf"^getting started with {TECH}\b"))
MIN_LINES = 10
ORDERED = regex(r"^\s*\d+[.)]\s", "m")
IMPERATIVE = regex(r"^\s*(?:[-*+]\s+|>\s*)?(?:Run|Use|Create|Check|Verify|Open|Install|Add|Set|Read|Write|Call|Execute|Configure|Update|Remove|Delete|Ensure|Confirm|Inspect|Build|Copy|Move|Start|Stop|Apply|Generate|Choose|Select|Review|Validate|Save|Fill|Extract|Convert)\b")
VERIFICATION = regex(r"\b(?:verif\w*|check\w*|confirm\w*|test\w*|validat\w*)\b", "i")
FAILURE = "|".join(regex(p, "i") for p in (r"\bif\b[^.\n]{0,60}\bfails?\b", r"\bon\s+error\b", r"\botherwise\b", r"\bfallback\b", r"\bin\s+case\b"))
MODIFIER = regex(r"\b([Aa]lways|[Nn]ever)\s+([A-Za-z`][\w'`-]*(?:[ \t]+[A-Za-z`][\w'`-]*){0,4})")
LEAD_VERBS = "use keep make write add prefer apply include put run".split()
STOPWORDS = "a an the to of for in on at with into from by your this that it them all any before after until unless when".split()
MAJOR_DOMAINS = "github.com npmjs.com pypi.org anthropic.com openai.com google.com microsoft.com wikipedia.org stackoverflow.com mozilla.org modelcontextprotocol.io docs.python.org nodejs.org".split()
URL = r"(?i)https?://([a-z0-9](?:[a-z0-9.-]*[a-z0-9])?)"


def truncate(x: Column, most: int = 60) -> Column:
    return F.when(utf16_length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("…")))


def front_string(key: str) -> Column:
    """A frontmatter value, if it is a string."""
    v = F.try_variant_get(F.try_parse_json(F.col("fm_json")), f"$.{key}", "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.get_json_object("fm_json", f"$.{key}"))


def front_line(key: Column) -> Column:
    """The line of a frontmatter key: the first line of the frontmatter that starts with it, else 1."""
    lines = F.split("raw", "\n", -1)
    found = F.filter(F.transform(lines, lambda x, i: F.when((i < F.col("body_start_line")) & F.startswith(x, F.concat(key, F.lit(":"))), i + 1)), lambda i: i.isNotNull())
    return F.coalesce(F.get(found, F.lit(0)), F.lit(1))


def description() -> Column:
    d = trimmed(front_string("description"))
    return F.when(d != "", d)


def body_line(line: Column) -> Column:
    return line + F.col("body_start_line") - 1


def claims(skill: DataFrame) -> DataFrame:
    """(path, positive, words, own: the words as text and their line) of each "always ..." or "never ..." phrase of a body: function words and a general leading verb are left out."""
    found = skill.where((F.col("body") != "") & D.any_word(F.col("body"), ("lways", "ever")) & F.col("body").rlike(MODIFIER)).select("path", "body_start_line", F.explode(matches(F.col("body"), MODIFIER)).alias("h"))
    words = F.filter(F.split(F.replace(F.lower(F.regexp_extract("h.match", MODIFIER, 2)), F.lit("`"), F.lit("")), "[ \t]+"), lambda w: (w != "") & ~w.isin(STOPWORDS))
    words = F.when(F.get(words, F.lit(0)).isin(LEAD_VERBS), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
    told = found.select("path", (F.lower(F.regexp_extract("h.match", MODIFIER, 1)) == "always").alias("positive"), words.alias("words"), body_line(F.col("h.line")).alias("line")).where(F.size("words") > 0).distinct()
    return told.select("path", "positive", "words", F.struct(F.size("words").alias("size"), F.array_join("words", " ").alias("object"), "line").alias("own"))


def contradictions(skill: DataFrame) -> DataFrame:
    """SK304: pairs of claims where the shorter object starts the longer one; a single word must be the whole."""
    short = F.when(F.col("a.size") <= F.col("n.size"), F.col("a.object")).otherwise(F.col("n.object"))
    told = opposed(claims(skill)).select("path", short.alias("object"), F.col("a.line").alias("a"), F.col("n.line").alias("n")).distinct()
    return rows(told, TYPE, "SK304", hit(text('"always ', F.col("object"), '" (line ', F.col("a"), ') contradicts "never ', F.col("object"), '" (line ', F.col("n"), ")"), file=FILE, line=F.least("a", "n")))


def detector_hits(found: Column, file: Column | str, line, message) -> Column:
    return F.transform(found, lambda h: hit(message(h), file=file, line=line(h)))


def domains() -> Column:
    """The first link to each domain outside the major ones."""
    found = F.transform(matches(F.col("body"), URL), lambda h: F.struct(F.lower(F.regexp_extract(h["match"], URL, 1)).alias("d"), h["line"].alias("line")))
    minor = F.filter(found, lambda x: ~F.regexp_like(x["d"], F.lit(rf"^(?:.*\.)?(?:{'|'.join(d.replace('.', chr(92) + '.') for d in MAJOR_DOMAINS)})$")))
    first = F.transform(F.array_distinct(minor["d"]), lambda d: F.get(F.filter(minor, lambda x: x["d"] == d), F.lit(0)))
    return F.transform(first, lambda x: hit(text('links to external domain "', x["d"], '" — surfaced for review, not judged'), file=FILE, line=body_line(x["line"])))


@built_once
def row_rules(config: Config) -> dict[str, Column]:
    """Rules over the skill row, as arrays of hits. The row has `name_`, `desc` and `name_line` besides its own columns."""
    b = config.budgets
    has_body, has_raw = F.col("body") != "", F.col("raw") != ""
    body, name, desc = F.col("body"), F.col("name_"), F.col("desc")
    present, error = F.coalesce("fm_present", F.lit(False)), F.coalesce("fm_error", F.lit(""))
    named = name.isNotNull() & (trimmed(name) != "")
    folder = F.element_at(F.filter(F.split(F.col("skill_file_path"), r"[\\/]", -1), lambda s: s != ""), F.lit(-2))
    long = filled_lines(body) > MIN_LINES
    english = desc.isNotNull() & (word_count(desc) >= MIN_WORDS) & mostly_english(desc)
    # A pattern made of a row's value is compiled anew each time, so only for the verbs that are there
    verbs = let(F.lower(desc), lambda low: F.filter(F.array(*map(F.lit, VERBS)), lambda v: F.contains(low, v) & F.regexp_like(low, F.concat(F.lit(r"(?<![A-Za-z0-9_])"), v, F.lit(r"(?:s|es|ed|ing)?(?![A-Za-z0-9_])")))))
    short = utf16_length(desc) < b.descriptionMinChars
    placeholder = F.coalesce(*[F.nullif(F.regexp_extract(desc, p, 0), F.lit("")) for p in PLACEHOLDERS])
    lines = F.split(body, "\n", -1)
    headings = F.filter(F.transform(lines, lambda x, i: F.struct(trimmed(F.regexp_extract(x, regex(r"^#{1,6}\s+(.*)$"), 1)).alias("t"), i.alias("i"), x.rlike(regex(r"^#{1,6}\s+")).alias("is"))), lambda x: x["is"] & F.regexp_like(F.lower(x["t"]), F.lit(BOILERPLATE)))
    space = f"[{SPACE_IN_CLASS}]"
    paths = F.filter(matches(body, ABSOLUTE_PATH), lambda h: ~F.contains(F.element_at(F.split(F.substring(body, F.lit(1), h["pos"]), space, -1), -1), F.lit("://")))
    n_lines, tokens = F.col("body_line_count"), F.col("tokens_body")
    return {
        "SK001": when(~F.col("file_exists"), hit(text("SKILL.md is missing or unreadable in ", F.col("path")), foundational=True)),
        "SK002": F.when(~F.col("file_exists"), none())
        .when(~present, F.array(hit("SKILL.md has no YAML frontmatter block", foundational=True, line=1)))
        .when(error != "", F.array(hit(text("frontmatter is not valid YAML: ", error), foundational=True, line=1)))
        .otherwise(F.concat(*[when(F.col("fm_json").isNotNull() & (F.coalesce(trimmed(front_string(k)), F.lit("")) == ""), hit(f'frontmatter is missing required "{k}"', line=1)) for k in ("name", "description")])),
        "SK003": F.when(
            named,
            F.concat(
                when(~name.rlike(KEBAB), hit(text('skill name "', name, '" is not kebab-case (expected ^[a-z0-9]+(-[a-z0-9]+)*$)'), file=FILE, line=F.col("name_line"))),
                when(utf16_length(name) > MAX_NAME, hit(text("skill name is ", utf16_length(name), f" chars (max {MAX_NAME})"), file=FILE, line=F.col("name_line"))),
                when(folder.isNotNull() & ~folder.isin(".", "..") & (name != folder), hit(text('skill name "', name, '" differs from its directory basename "', folder, '"'), file=FILE, line=F.col("name_line"))),
            ),
        ).otherwise(none()),
        "SK004": F.when(F.col("fm_json").isNotNull(), F.transform(F.filter(F.coalesce(F.json_object_keys("fm_json"), F.array().cast("array<string>")), lambda k: ~k.isin(KNOWN_KEYS)), lambda k: hit(text('unknown frontmatter key "', k, '"'), file=FILE, line=front_line(k)))).otherwise(none()),
        "SK006": F.when(has_body & D.any_word(body, ABSOLUTE_PATH_WORDS), F.transform(paths, lambda h: hit(text('absolute local path "', h["match"], '" will not resolve on other machines'), file=FILE, line=body_line(h["line"])))).otherwise(none()),
        "SK101": F.when(desc.isNull(), none()).when(short, F.array(hit(text("description is ", utf16_length(desc), f" chars (minimum {b.descriptionMinChars:g})")))).otherwise(when(placeholder.isNotNull(), hit(text('description contains placeholder text "', placeholder, '"')))),
        "SK102": when(utf16_length(desc) > b.descriptionMaxChars, hit(text("description is ", utf16_length(desc), f" chars (budget {b.descriptionMaxChars:g})"))),
        "SK103": when(english & ~desc.rlike(USAGE), hit('description never says when to use the skill (no "use when", "for tasks", "when the user", or similar)')),
        "SK104": when(english & (F.size(verbs) < 2), hit(text("description names ", F.when(F.size(verbs) == 1, F.concat(F.lit('only "'), F.get(verbs, F.lit(0)), F.lit('"'))).otherwise("none"), " of the concrete action verbs hosts route on (need 2+)"))),
        "SK105": when(desc.rlike(FIRST_PERSON), hit(text('description uses first-person phrasing ("', F.regexp_extract(desc, FIRST_PERSON, 0), '")'))),
        "SK201": when((tokens > b.skillBodyTokensInfo) & (tokens <= b.skillBodyTokensWarn), hit(text("body is ~", tokens, f" tokens (info budget {b.skillBodyTokensInfo:g})"))),
        "SK202": when(tokens > b.skillBodyTokensWarn, hit(text("body is ~", tokens, f" tokens (budget {b.skillBodyTokensWarn:g})"))),
        "SK203": when((n_lines > b.skillBodyMaxLines) & (F.col("n_refs") == 0), hit(text("body is ", n_lines, f" lines (budget {b.skillBodyMaxLines:g}) with zero links to companion files"))),
        "SK204": F.when(has_body, F.transform(F.filter(fenced_blocks(body), lambda x: x["lines"] > b.skillCodeBlockMaxLines), lambda x: hit(text("fenced code block is ", x["lines"], f" lines (budget {b.skillCodeBlockMaxLines:g})"), file=FILE, line=body_line(x["open_line"])))).otherwise(none()),
        "SK205": F.when(has_body, F.transform(headings, lambda x: hit(text('section "', x["t"], '" teaches basics the model already knows'), file=FILE, line=x["i"] + F.col("body_start_line")))).otherwise(none()),
        "SK301": when(long & ~body.rlike(ORDERED) & ~F.exists(lines, lambda x: x.rlike(IMPERATIVE)), hit("body has no ordered list and no imperative step lines — the workflow is buried in prose")),
        "SK302": when(long & ~body.rlike(VERIFICATION), hit("body never tells the model to verify, check, or validate its output")),
        "SK303": when(long & ~body.rlike(FAILURE), hit('body has no failure-path guidance (no "if … fails", "otherwise", or fallback)')),
        "SK401": F.when(has_raw, detector_hits(D.injection_phrases(F.col("raw")), FILE, lambda h: h["line"], lambda h: text("injection phrase (", h["kind"], '): "', truncate(h["match"]), '"'))).otherwise(none()),
        "SK402": F.when(has_raw, detector_hits(D.hidden_unicode(F.col("raw")), FILE, lambda h: h["line"], lambda h: text("hidden ", h["kind"], " character ", h["match"]))).otherwise(none()),
        "SK403": F.when(has_raw, detector_hits(D.secrets(F.col("raw")), FILE, lambda h: h["line"], lambda h: text(h["kind"], " detected: ", h["match"]))).otherwise(none()),
        "SK404": F.when(has_body, detector_hits(D.fetch_execute(body), FILE, lambda h: body_line(h["line"]), lambda h: text("fetch-and-execute pattern (", h["kind"], '): "', truncate(h["match"]), '"'))).otherwise(none()),
        "SK405": F.when(has_body, detector_hits(D.base64_blobs(body, int(b.base64MinLength)), FILE, lambda h: body_line(h["line"]), lambda h: text("base64-looking blob ", h["match"]))).otherwise(none()),
        "SK406": F.when(has_body, domains()).otherwise(none()),
    }


@built_once
def resource_rules() -> dict[str, Column]:
    """Rules over a resource file's row; file is the resource."""
    c, f = F.col("content"), F.col("resource")
    line = lambda h: h["line"]
    return {
        "SK401": F.when(F.col("has_raw"), detector_hits(D.injection_phrases(c), f, line, lambda h: text("injection phrase (", h["kind"], ') in resource file: "', truncate(h["match"]), '"'))).otherwise(none()),
        "SK402": F.when(F.col("has_raw"), detector_hits(D.hidden_unicode(c), f, line, lambda h: text("hidden ", h["kind"], " character ", h["match"], " in resource file"))).otherwise(none()),
        "SK403": F.when(F.col("has_raw"), detector_hits(D.secrets(c), f, line, lambda h: text(h["kind"], " detected in resource file: ", h["match"]))).otherwise(none()),
        "SK404": F.when(F.col("has_body"), detector_hits(D.fetch_execute(c), f, line, lambda h: text("fetch-and-execute pattern (", h["kind"], ') in resource file: "', truncate(h["match"]), '"'))).otherwise(none()),
    }


def similar_siblings(skill: DataFrame, threshold: float) -> DataFrame:
    """SK106: skills of one repository whose descriptions share more than `threshold` of their words, in both directions."""
    own = skill.select("repo", "path", "name", word_set(F.col("desc")).alias("w"))
    other = own.select("repo", F.col("path").alias("o_path"), F.col("name").alias("o_name"))
    alike = alike_sets(own.select("repo", "path", "w"), threshold).join(unsent(other), ["repo", "o_path"])
    return rows(alike, TYPE, "SK106", hit(text("description is ", F.floor(F.col("similarity") * 100 + 0.5).cast("long"), '% similar to sibling skill "', F.col("o_name"), f'" (threshold {int(threshold * 100 + 0.5)}%)')))


def skill_hits(skill: DataFrame, refs: DataFrame, resources: DataFrame, config: Config) -> DataFrame:
    """Hits of all active skill rules."""
    on = set(active(TYPE, config.rules))
    n_refs = refs.groupBy("path").agg(F.count(F.lit(1)).alias("n_refs"))
    full = spread(skill.join(unsent(n_refs), "path", "left"), "path").fillna({"n_refs": 0, "raw": "", "body": ""})
    full = full.withColumns({"name_": front_string("name"), "desc": description(), "name_line": front_line(F.lit("name"))})
    out = by_row(full, TYPE, {k: v for k, v in row_rules(config).items() if k in on})
    if "SK005" in on:
        out = out.unionByName(rows(refs.where(~F.col("exists")), TYPE, "SK005", hit(text('linked file "', F.col("link"), '" does not exist in the skill directory'), file=FILE, line=F.col("line"))))
    if "SK106" in on:
        out = out.unionByName(similar_siblings(full, config.budgets.similarityJaccard))
    if "SK304" in on:
        out = out.unionByName(contradictions(full))
    flags = full.select("path", (F.col("raw") != "").alias("has_raw"), (F.col("body") != "").alias("has_body"))
    return out.unionByName(by_row(spread(resources.where("content IS NOT NULL").join(unsent(flags), "path"), "path", "resource"), TYPE, {k: v for k, v in resource_rules().items() if k in on}))
