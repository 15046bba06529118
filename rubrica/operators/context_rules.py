"""Rules for agent context files.

ctx: path, name, kind, raw, tokens_total. ctx_file_ref: path, ref, exists, line. ctx_command_ref: path, command, known, line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.functions import detectors as D
from rubrica.functions.text import matches, regex, trimmed
from rubrica.operators.catalog import active
from rubrica.operators.hits import built_once, by_row, hit, none, rows, text
from rubrica.operators.joins import opposed

TYPE = "context-file"

# Patterns of the rules.
ABSOLUTE = regex(r"\b(always|never)[ \t]+((?:[A-Za-z0-9'’-]+[ \t]+){0,3}[A-Za-z0-9'’-]+)", "i")
FILLER = "|".join(("^what is (?:react|git|javascript|typescript|python|node(?:\\.js)?|npm|docker)$", "^how (?:git|npm|react|docker|the internet) works$", "^introduction to (?:javascript|typescript|python|git|react|node(?:\\.js)?)$", "^(?:git|javascript|typescript|python) basics$"))
HEADING = r"(?m)^#{1,6}[ \t]+([^\n]+)$"


def normal_heading(t: Column) -> Column:
    return F.lower(F.regexp_replace(trimmed(F.regexp_replace(t, "[*_`]", "")), "[?!.:]+$", ""))


def absolutes(ctx: DataFrame) -> DataFrame:
    """(path, positive, words, own: place, phrase and line) of each "always ..." or "never ..." phrase; every token counts. Of phrases with the same tokens the first stands for all."""
    found = ctx.where(D.any_word(F.lower("raw"), ("always", "never")) & F.col("raw").rlike(ABSOLUTE)).select("path", F.explode(matches(F.col("raw"), ABSOLUTE)).alias("h"))
    first, rest = F.regexp_extract("h.match", ABSOLUTE, 1), F.regexp_extract("h.match", ABSOLUTE, 2)
    told = found.select("path", (F.lower(first) == "always").alias("positive"), F.split(F.lower(rest), "[ \t]+").alias("words"), F.struct("h.pos", F.concat(first, F.lit(" "), rest).alias("phrase"), "h.line").alias("own"))
    return told.groupBy("path", "positive", "words").agg(F.min("own").alias("own"))


def contradictions(ctx: DataFrame) -> DataFrame:
    """CTX004: pairs where the shorter phrase starts the longer; a single token must be the whole; one hit for each pair of token lists."""
    told = opposed(absolutes(ctx))
    return rows(told, TYPE, "CTX004", hit(text('"', F.col("a.phrase"), '" (line ', F.col("a.line"), ') contradicts "', F.col("n.phrase"), '" (line ', F.col("n.line"), ")"), line=F.least("a.line", "n.line")))


def grouped(n: Column) -> Column:
    return F.format_number(n, 0)


@built_once
def row_rules(config: Config) -> dict[str, Column]:
    b, raw, total = config.budgets, F.col("raw"), F.col("tokens_total")
    budget = F.when(total > b.ctxTokensWarn, F.lit(int(b.ctxTokensWarn))).otherwise(F.lit(int(b.ctxTokensInfo)))
    over = hit(text(F.col("name"), " is ~", grouped(total), " tokens (budget ", grouped(budget), ") — this cost is paid on every conversation, before the agent does any work"), severity=F.when(total > b.ctxTokensWarn, "warn").otherwise("info"), meta=F.create_map(F.lit("tokens"), total.cast("string"), F.lit("budget"), budget.cast("string")))
    headings = F.filter(F.transform(matches(raw, HEADING), lambda h: F.struct(trimmed(F.regexp_extract(h["match"], HEADING, 1)).alias("t"), h["line"].alias("line"))), lambda x: normal_heading(x["t"]).rlike(FILLER))
    unsafe = F.concat(
        F.transform(D.injection_phrases(raw), lambda h: hit(text('injection phrase "', h["match"], '" (', h["kind"], ")"), line=h["line"])),
        F.transform(D.hidden_unicode(raw), lambda h: hit(text("hidden ", h["kind"], " character ", h["match"]), line=h["line"])),
        F.transform(D.secrets(raw), lambda h: hit(text(h["kind"], ' "', h["match"], '" committed to context'), line=h["line"])),
    )
    return {
        "CTX001": F.when(total > b.ctxTokensInfo, F.array(over)).otherwise(none()),
        "CTX005": F.transform(headings, lambda x: hit(text('section "', x["t"], '" is generic background the model already knows'), line=x["line"])),
        "CTX006": unsafe,
    }


def context_hits(ctx: DataFrame, file_refs: DataFrame, command_refs: DataFrame, config: Config) -> DataFrame:
    """Hits of all active context-file rules."""
    on = set(active(TYPE, config.rules))
    full = ctx.fillna({"raw": ""})
    out = by_row(full, TYPE, {k: v for k, v in row_rules(config).items() if k in on})
    if "CTX004" in on:
        out = out.unionByName(contradictions(full))
    if "CTX002" in on:
        out = out.unionByName(rows(file_refs.where(~F.col("exists")), TYPE, "CTX002", hit(text("references ", F.col("ref"), ", which does not exist"), line=F.col("line"))))
    if "CTX003" in on:
        tool = F.split("command", " ")[0]
        manifest = F.when(tool == "make", "the Makefile").when(tool == "just", "the justfile").otherwise("package.json")
        out = out.unionByName(rows(command_refs.where(~F.col("known")), TYPE, "CTX003", hit(text('command "', F.col("command"), '" does not match any target in ', manifest), line=F.col("line"))))
    return out
