"""Artifacts from file tables.

Every adapter works on a table of files (repo, path, size, content) with slash-separated paths; `read_tree` makes one from a folder at any shared location. A lake of
repositories can be handed over as such a table directly, so parsing is distributed by file.
"""

from __future__ import annotations

import json
import os
import re
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.config import UserError
from rubrica.functions.text import approximate_tokens, line_count, matches
from rubrica.sources.files import FILES, FileTree
from rubrica.sources.references import MANIFESTS, commands, file_mentions, manifest_targets, masked, resolved
from rubrica.tables import unsent

# Names, patterns and limits of the adapters.
CONTEXT_NAMES = {"CLAUDE.md": "claude-md", "AGENTS.md": "agents-md", "GEMINI.md": "gemini-md", ".cursorrules": "cursorrules"}
FRONTMATTER = r"^\x{feff}?---\r?\n([\s\S]*?)\r?\n---[ \t]*(?:\r?\n|\z)"
TEXT_RESOURCE = r"(?i)\.(?:md|mdx|txt|py|sh|bash|js|mjs|cjs|ts|json|yaml|yml|toml|csv|xml|html)$"
MAX_RESOURCE_BYTES = 262_144
LINK = r"\[[^\]]*\]\(([^)\s]+)(?:\s+\"[^\"]*\")?\)"
NOT_RELATIVE = r"^(?:[a-z][a-z0-9+.-]*:|#|/|\\|[A-Za-z]:[\\/])"


def is_context_file(path: str) -> bool:
    """One of four names, or a Markdown file in .cursor/rules."""
    parts = path.split("/")
    return parts[-1] in CONTEXT_NAMES or (parts[-3:-1] == [".cursor", "rules"] and parts[-1].endswith((".md", ".mdc")))


def detect_target(path: str) -> tuple[str, str]:
    """("skill" | "context-file" | "repo", path) of a file or folder."""
    if os.path.isfile(path):
        if os.path.basename(path) == "SKILL.md":
            return "skill", os.path.dirname(path) or "."
        if is_context_file(os.path.abspath(path)):
            return "context-file", path
        raise UserError(f"unrecognized artifact: {path}")
    if not os.path.isdir(path):
        raise UserError(f"path not found: {path}")
    return ("skill" if os.path.isfile(os.path.join(path, "SKILL.md")) else "repo"), path


def read_tree(spark: SparkSession, root: str, repo: str | None = None, ignore: tuple[str, ...] = ()) -> DataFrame:
    """A folder, by path or URI of a file system that the executors reach, as a file table; see sources.files."""
    spark.dataSource.register(FileTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # Python sources take filters only where this is on
    reader = spark.read.format("file_tree").option("root", root).option("ignore", ",".join(ignore))
    return (reader.option("repo", repo) if repo else reader.option("repo", root if "://" in root else os.path.abspath(root))).load()


#: Values that a frontmatter may come to once its aliases are spelled out, and levels that it may nest.
MOST_VALUES = 100_000


def spelled_out(value: object, known: dict[int, int] | None = None) -> int:
    """How many values there are once every alias is written out; MOST_VALUES + 1 stands for more."""
    known = {} if known is None else known
    if not isinstance(value, (dict, list)):
        return 1
    if id(value) not in known:
        known[id(value)] = MOST_VALUES + 1  # what holds itself has no end
        own = [*value.values(), *value] if isinstance(value, dict) else value
        known[id(value)] = min(MOST_VALUES + 1, 1 + sum(spelled_out(x, known) for x in own))
    return known[id(value)]


YAML = T.StructType([T.StructField("json", T.StringType()), T.StructField("error", T.StringType())])


@cache
def yaml_loader():
    """A loader of YAML 1.2's core schema: true and false alone are booleans, dates are strings, and a key that comes twice is an error."""
    import yaml

    class Loader(yaml.SafeLoader):
        yaml_implicit_resolvers: dict = {}

    def mapping(loader, node):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=True)
            if key in out:
                raise yaml.constructor.ConstructorError(None, None, f"key {key!r} comes twice", k.start_mark)
            out[key] = loader.construct_object(v, deep=True)
        return out

    number = {"0o": 8, "0x": 16}
    for tag, pattern, first in (("null", r"^(?:~|null|Null|NULL|)$", ["~", "n", "N", ""]), ("bool", r"^(?:true|True|TRUE|false|False|FALSE)$", list("tTfF")), ("int", r"^(?:[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+)$", list("-+0123456789")), ("float", r"^(?:[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?|[-+]?\.(?:inf|Inf|INF)|\.(?:nan|NaN|NAN))$", list("-+0123456789."))):
        Loader.add_implicit_resolver(f"tag:yaml.org,2002:{tag}", re.compile(pattern), first)
    Loader.add_constructor("tag:yaml.org,2002:int", lambda loader, node: int(node.value[2:], number[node.value[:2]]) if node.value[:2] in number else int(node.value))
    Loader.add_constructor("tag:yaml.org,2002:bool", lambda loader, node: node.value.lower() == "true")
    Loader.add_constructor("tag:yaml.org,2002:map", mapping)
    return Loader


@F.pandas_udf(YAML)
def parse_yaml(texts: pd.Series) -> pd.DataFrame:
    """A YAML mapping as ordered JSON, or why it is none; YAML has no native reader, hence Python."""
    import yaml

    def one(t: str | None) -> tuple[str | None, str | None]:
        if t is None:
            return None, None
        try:
            v = yaml.load(t, Loader=yaml_loader())  # noqa: S506  a safe loader
            if not isinstance(v, dict):
                return None, "frontmatter is not a YAML mapping"
            if spelled_out(v) > MOST_VALUES:
                return None, f"aliases stand for more than {MOST_VALUES} values"
            return json.dumps({str(k): x for k, x in v.items()}, ensure_ascii=False, default=str), None
        except RecursionError:
            return None, "values are nested too deeply"
        except (yaml.YAMLError, ValueError, TypeError, ArithmeticError) as e:
            return None, str(e).split("\n")[0] or "invalid YAML"

    return pd.DataFrame([one(t) for t in texts], columns=["json", "error"])


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def entries(files: DataFrame) -> DataFrame:
    """(repo, entry) of every file and every folder above one."""
    parts = F.split("path", "/")
    return files.select("repo", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("entry")).union(files.select("repo", F.lit(".").alias("entry"))).distinct()


def skills(files: DataFrame, tokens=approximate_tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(skill, skill_ref, skill_resource) of every folder with a SKILL.md. tokens: a counter of a text column; the default is an approximation."""
    raw = files.where(basename(F.col("path")) == "SKILL.md").select("repo", dirname(F.col("path")).alias("folder"), F.coalesce("content", F.lit("")).alias("raw"))
    head = F.regexp_extract("raw", FRONTMATTER, 0)
    own = raw.withColumn("head", head).withColumn("front", F.when(F.col("head") != "", F.regexp_extract("raw", FRONTMATTER, 1)))
    own = own.withColumn("yaml", parse_yaml("front")).withColumn("body", F.substring(F.col("raw"), F.length("head") + 1, F.length("raw")))
    own = own.withColumn("body_start_line", F.when(F.col("head") != "", line_count(F.col("head")) + 1).otherwise(1))
    folder = F.when(F.col("folder") == "", basename(F.col("repo"))).otherwise(basename(F.col("folder")))
    named = F.get_json_object("yaml.json", "$.name")
    skill = own.select(
        "repo",
        F.concat_ws("/", "repo", F.nullif("folder", F.lit(""))).alias("path"),
        F.when(F.trim(F.coalesce(named, F.lit(""))) != "", named).otherwise(folder).alias("name"),
        F.concat_ws("/", "repo", F.nullif("folder", F.lit("")), F.lit("SKILL.md")).alias("skill_file_path"),
        F.lit(True).alias("file_exists"),
        "raw",
        F.col("front").isNotNull().alias("fm_present"),
        F.col("yaml.json").alias("fm_json"),
        F.col("yaml.error").alias("fm_error"),
        "body",
        F.col("body_start_line").cast("int"),
        F.when(F.col("body") == "", 0).otherwise(line_count(F.col("body")) + 1).cast("int").alias("body_line_count"),
        tokens(F.col("raw")).alias("tokens_total"),
        tokens(F.col("body")).alias("tokens_body"),
        "folder",
    )
    links = skill.select("repo", "path", "folder", "body_start_line", F.explode(matches(F.col("body"), LINK)).alias("m")).withColumn("link", F.regexp_extract("m.match", LINK, 1))
    links = links.where(~F.col("link").rlike(f"(?i){NOT_RELATIVE}")).withColumn("bare", F.regexp_extract("link", "^[^#?]*", 0)).where("bare <> ''")
    listed = entries(files).withColumn("exists", F.lit(True))
    refs = links.withColumn("entry", resolved(F.col("folder"), F.col("bare"))).join(unsent(listed), ["repo", "entry"], "left").select("path", "link", F.coalesce("exists", F.lit(False)).alias("exists"), (F.col("m.line") + F.col("body_start_line") - 1).alias("line"))
    # Files that aren't text, and large ones, are resources without content
    readable = F.col("path").rlike(TEXT_RESOURCE) & (F.col("size") <= MAX_RESOURCE_BYTES)
    texts = files.where(basename(F.col("path")) != "SKILL.md").withColumn("content", F.when(readable, F.col("content")))
    # A file belongs to every skill folder above it: its ancestors are few, so the join is on folders
    above = F.transform(F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1), lambda k: F.array_join(F.slice(F.split("path", "/"), F.lit(1), k), "/"))
    held = texts.withColumn("folder", F.explode(above)).withColumnRenamed("path", "file")
    resources = held.join(unsent(skill.select("repo", "folder", "path")), ["repo", "folder"]).select("path", F.when(F.col("folder") == "", F.col("file")).otherwise(F.substring(F.col("file"), F.length("folder") + 2, F.length("file"))).alias("resource"), "content")
    return skill.drop("folder"), refs, resources


def context_files(files: DataFrame, tokens=approximate_tokens) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ctx, ctx_file_ref, ctx_command_ref) of every context file."""
    name = basename(F.col("path"))
    cursor = F.col("path").rlike(r"(?:^|/)\.cursor/rules/[^/]*\.mdc?$")
    own = files.where(name.isin(list(CONTEXT_NAMES)) | cursor).select("repo", F.col("path").alias("file"), dirname(F.col("path")).alias("folder"), F.coalesce("content", F.lit("")).alias("raw"), name.alias("name"), cursor.alias("cursor"))
    own = own.withColumn("path", F.concat_ws("/", "repo", "file"))
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in CONTEXT_NAMES.items() for x in kv]), F.col("name"))
    ctx = own.select("repo", "path", "name", F.coalesce(kind, F.when(F.col("cursor"), "cursor-rules").otherwise("claude-md")).alias("kind"), "raw", tokens(F.col("raw")).alias("tokens_total"))

    texts = masked(own.select("repo", "path", "folder", "raw"))
    listed = entries(files).withColumn("exists", F.lit(True))
    found = file_mentions(texts).select("repo", "path", "ref", "pos", "line", "sure", resolved(F.col("folder"), F.col("ref")).alias("entry"))
    told = found.join(unsent(listed), ["repo", "entry"], "left").withColumn("exists", F.coalesce("exists", F.lit(False))).where("sure OR exists")
    file_refs = told.groupBy("path", "ref").agg(F.min_by("exists", "pos").alias("exists"), F.min_by("line", "pos").alias("line"))
    names = [(n, k, i) for k, own_names in MANIFESTS.items() for i, n in enumerate(own_names)]
    table = files.sparkSession.createDataFrame(names, "base string, kind string, rank int")
    # The manifest kinds are a fixed table of a few rows
    content = F.coalesce("content", F.lit(""))
    manifests = files.withColumn("base", basename(F.col("path"))).join(F.broadcast(table), "base").groupBy("repo", dirname(F.col("path")).alias("folder"), "kind").agg(F.min_by(content, "rank").alias("content"))
    keys = ["repo", "folder", "kind"]
    first = F.min(F.struct("pos", "line")).alias("m")
    calls = commands(texts).groupBy("path", "command", *keys, "target").agg(first)
    known = F.col("targets").isNull() | F.array_contains("targets", F.col("target"))
    command_refs = calls.join(unsent(manifest_targets(manifests)), keys, "left").select("path", "command", known.alias("known"), F.col("m.line").alias("line"))
    return ctx, file_refs, command_refs
