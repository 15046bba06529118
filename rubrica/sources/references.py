"""What a context file refers to, as tables: files it mentions and commands it tells to run, and the targets that manifests define.

All of it is native: a text's candidates are the matches of a pattern in a masked copy of it, exploded to rows, and every test on a candidate
is a column. Masked copies keep every place, so candidates of different kinds sort by where they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rubrica.functions.text import SPACE_IN_CLASS, matches, regex, trimmed

# Names, extensions and patterns of references, commands and manifests.
SOURCE_EXTENSIONS = "ts js tsx jsx py md json yaml yml toml sh go rs java rb css html".split()
FRAMEWORKS = "node.js deno.js react.js next.js vue.js nuxt.js angular.js express.js nest.js ember.js backbone.js alpine.js three.js d3.js chart.js".split()
BUILTINS = "add audit bin cache config create dedupe dlx env exec global help i import info init install licenses link list login logout ls node outdated pack patch prune publish rebuild remove rm run setup store uninstall unlink up update upgrade version whoami why workspace workspaces".split()
FENCE_MARK = regex(r"^\s*(```+|~~~+)")
CODE_SPAN = r"`([^`\n]+)`"
LINK = regex(r"\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)")
#: What ends a bare word. Letters and digits stand first in the classes, as most characters are told by them.
ENDS_WORD = SPACE_IN_CLASS + r"""|()\[\]\"'`,;="""
IN_WORD, IN_WORD_PLAIN = f"[a-zA-Z0-9[^{ENDS_WORD}]]", f"[a-zA-Z0-9[^{ENDS_WORD}./]]"
#: A word that has a dot or slash, as all do that could name a file; it is looked for at the start of a word only, once.
BARE_WORD = f"(?<!{IN_WORD}){IN_WORD_PLAIN}*+[./]{IN_WORD}*+"
COMMAND = r"(?<![A-Za-z0-9_])(npm|pnpm|yarn|make|just)[ \t]+([A-Za-z0-9_:.-]+)(?:[ \t]+([A-Za-z0-9_:.-]+))?"
ELSEWHERE = regex(r"\bcd\s+\S+\s*(?:&&|;)")
HOST_SEGMENT = r"(?i)^[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}$"
MAKE_TARGETS = regex(r"^([^\s:=][^:=]*):(?!=)")
JUST_RECIPE = regex(r"^@?([A-Za-z_][A-Za-z0-9_-]*)(?:\s+[^:=\n]*)?:(?!=)")
MANIFESTS = {"package": ["package.json"], "make": ["Makefile", "makefile", "GNUmakefile"], "just": ["justfile", "Justfile", ".justfile"]}


def spaces_for(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]", " ")


def without(text: Column, pattern: str) -> Column:
    """The text with all matches of a pattern as spaces; newlines and places stay."""
    between, found = F.split(text, pattern, -1), F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spaces_for)
    return F.array_join(F.zip_with(between, found, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")


def without_fences(text: Column) -> Column:
    """The text with its fenced regions as spaces: from a line that opens with backticks or tildes to the next that opens alike, or to the end."""
    lines = F.split(text, "\n", -1)
    marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("at"), F.substring(F.regexp_extract(x, FENCE_MARK, 1), 1, 1).alias("mark"))), lambda m: m["mark"] != "")
    none = F.struct(F.lit(-1).alias("since"), F.lit("").alias("mark"), F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(s: Column, m: Column) -> Column:
        begins, ends = s["since"] < 0, (s["since"] >= 0) & (m["mark"] == s["mark"])
        since = F.when(begins, m["at"]).when(ends, F.lit(-1)).otherwise(s["since"])
        region = F.struct(s["since"].alias("a"), m["at"].alias("b"))
        return F.struct(since.alias("since"), F.when(begins, m["mark"]).otherwise(s["mark"]).alias("mark"), F.when(ends, F.array_append(s["done"], region)).otherwise(s["done"]).alias("done"))

    open_end = lambda s: F.when(s["since"] >= 0, F.array_append(s["done"], F.struct(s["since"].alias("a"), F.lit(2**31 - 1).alias("b")))).otherwise(s["done"])
    regions = F.aggregate(marks, none, step, open_end)
    return F.array_join(F.transform(lines, lambda x, i: F.when(F.exists(regions, lambda r: (i >= r["a"]) & (i <= r["b"])), spaces_for(x)).otherwise(x)), "\n")


def masked(files: DataFrame) -> DataFrame:
    """files with unfenced, uncoded and unlinked: raw less its fences, its code spans too, its links too."""
    own = files.withColumn("unfenced", without_fences(F.col("raw")))
    own = own.withColumn("uncoded", without(F.col("unfenced"), CODE_SPAN))
    return own.withColumn("unlinked", without(F.col("uncoded"), LINK))


def mentions(files: DataFrame) -> DataFrame:
    """(..., source, pos, line, token) of each candidate; files: the result of masked()."""
    kinds = [("code", "unfenced", CODE_SPAN, 1), ("link", "uncoded", LINK, 1), ("bare", "unlinked", BARE_WORD, 0)]
    of = lambda source, text, pattern, group: F.transform(matches(F.col(text), pattern), lambda m: F.struct(F.lit(source).alias("source"), m["pos"].alias("pos"), m["line"].alias("line"), F.regexp_extract(m["match"], pattern, group).alias("token")))
    return files.withColumn("m", F.explode(F.concat(*[of(*k) for k in kinds]))).select("*", "m.*").drop("m")


def is_reference(ref: Column) -> Column:
    """Whether a token could name a file of the repository: each line is a reason why it couldn't."""
    reasons = [
        ref == "",
        F.contains(ref, F.lit("//")),
        ref.rlike("(?i)^[a-z][a-z0-9+.-]*:"),
        ref.rlike(r"[*?<>{}$%]"),
        F.contains(ref, F.lit("node_modules")),
        ref.rlike(r"^[/\\~@-]"),
        ref.rlike(r"^[A-Za-z]:[\\/]"),
    ]
    return ~F.array_contains(F.array(*reasons), True)


def file_mentions(files: DataFrame) -> DataFrame:
    """Candidates that name files: ref, and `sure`, whether it counts even if no such file exists."""
    token = trimmed(F.col("token"))
    plain = ~token.rlike(f"[{SPACE_IN_CLASS}]") & ~F.contains(token, F.lit("...")) & ~F.contains(token, F.lit("…"))
    ref = F.when(F.col("source") == "link", F.regexp_extract(token, "^[^#?]*", 0)).otherwise(F.regexp_extract(token, "^[^#]*", 0))
    for trailing in (r"[.,:;!]+$", r":\d+(?::\d+)?$"):
        ref = F.regexp_replace(ref, trailing, "")
    own = mentions(files).where(plain).withColumn("ref", ref).where(is_reference(F.col("ref")))
    known = F.lower(F.regexp_extract("ref", r"[^./]\.([A-Za-z0-9]+)$", 1)).isin(SOURCE_EXTENSIONS)
    nested, host = F.contains("ref", F.lit("/")), F.split("ref", "/")[0].rlike(HOST_SEGMENT)
    some = own.where((nested & ~host) | (~nested & known & ~F.lower("ref").isin(FRAMEWORKS)))
    return some.withColumn("sure", (F.col("source") == "link") | F.col("ref").rlike(r"^\.\.?/") | (known & nested))


def commands(files: DataFrame) -> DataFrame:
    """(..., command, kind, target, pos, line) of script, target and recipe calls; bare ones count in code only, none after a change of folder."""
    own = files.withColumn("m", F.explode(matches(F.col("raw"), COMMAND)))
    tool, first, second = (F.regexp_extract("m.match", COMMAND, i) for i in (1, 2, 3))
    before = F.element_at(F.split(F.substring(F.col("raw"), F.lit(1), F.col("m.pos")), "\n", -1), -1)
    in_code = F.substring(F.col("uncoded"), F.col("m.pos") + 1, F.lit(1)) == " "
    script, option = tool.isin("npm", "pnpm", "yarn"), lambda x: F.startswith(x, F.lit("-"))
    by_run = script & (first == "run")
    bare = in_code & (tool != "npm") & ~option(first) & ~(script & first.isin(BUILTINS))
    own = own.withColumn("target", F.when(by_run, F.when((second != "") & ~option(second), second)).when(bare, first))
    own = own.where(F.col("target").isNotNull() & ~before.rlike(ELSEWHERE))
    return own.select("*", F.concat_ws(" ", tool, F.when(by_run, "run"), "target").alias("command"), F.when(script, "package").otherwise(tool).alias("kind"), F.col("m.pos").alias("pos"), F.col("m.line").alias("line")).drop("m")


def manifest_targets(manifests: DataFrame) -> DataFrame:
    """manifests (kind, content, ...) that can be read, with the targets they define."""
    lines, content = F.split("content", "\n", -1), F.col("content")
    v = F.try_parse_json(content)
    keys = F.json_object_keys(F.get_json_object(content, "$.scripts"))
    scripts = F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.coalesce(keys, F.array().cast("array<string>")))
    heads = lambda pattern, some: F.filter(F.transform(F.filter(lines, some), lambda x: F.regexp_extract(x, pattern, 1)), lambda t: t != "")
    make = F.filter(F.split(F.array_join(heads(MAKE_TARGETS, lambda x: ~x.rlike("^[\t#]")), " "), f"[{SPACE_IN_CLASS}]+"), lambda t: t != "")
    targets = F.when(F.col("kind") == "package", scripts).when(F.col("kind") == "make", make).otherwise(heads(JUST_RECIPE, lambda x: F.lit(True)))
    return manifests.withColumn("targets", targets).where("targets IS NOT NULL").drop("content")


def resolved(folder: Column, link: Column) -> Column:
    """A relative link against its folder, with . and .. worked out; links that leave the tree keep their dots."""
    plain = F.coalesce(F.try_url_decode(F.replace(link, F.lit("+"), F.lit("%2B"))), link)
    parts = F.split(F.concat_ws("/", folder, plain), "/")

    def step(path: Column, x: Column) -> Column:
        back = (x == "..") & (F.size(path) > 0) & (F.coalesce(F.element_at(path, -1), F.lit("..")) != "..")
        return F.when(x.isin("", "."), path).when(back, F.slice(path, F.lit(1), F.size(path) - 1)).otherwise(F.array_append(path, x))

    path = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(path == "", ".").otherwise(path)
