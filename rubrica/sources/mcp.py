"""MCP catalogues from captured replies. Server commands found in configuration are never launched.

capture: path, name, transport, target, initialize (JSON result or null), initialize_error, pages (array of tools/list results as JSON), list_error, probed.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rubrica.functions.text import approximate_tokens, trimmed
from rubrica.operators.mcp_rules import json_string
from rubrica.tables import unsent

# The page cap and the words that mark a tool as changing things.
MAX_PAGES = 100
MUTATION = "delete remove destroy drop write create update set send post email message pay purchase buy order deploy publish push upload insert patch put execute kill restart reset revoke grant".split()


def page_problem(reply: Column) -> Column:
    """Why a tools/list result, as JSON, can't be used; null if it can."""
    tools, cursor = F.get_json_object(reply, "$.tools"), F.array_contains(F.json_object_keys(reply), "nextCursor")
    return (
        F.when(F.try_parse_json(reply).isNull(), "tools/list result is not JSON")
        .when(tools.isNull(), "tools/list result has no tools array")
        .when(~F.startswith(tools, F.lit("[")), "tools/list result: tools is not an array")
        .when(F.coalesce(cursor, F.lit(False)) & json_string(reply, "$.nextCursor").isNull(), "tools/list result: nextCursor is not a string")
    )


def listings(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, error; the pages of listings that are complete). pages: path, page from 0, reply, error (what kept the reply from coming, else null).

    Pages are followed as a client does: up to the first without a cursor, which ends the listing, or the first that fails, which empties it. An empty cursor is a cursor.
    """
    cursor = json_string(F.col("reply"), "$.nextCursor")
    told = pages.withColumns({"cursor": cursor, "problem": F.coalesce("error", page_problem(F.coalesce("reply", F.lit(""))))})
    told = told.withColumn("nth", F.row_number().over(Window.partitionBy("path", "cursor").orderBy("page")))
    again = F.col("cursor").isNotNull() & (F.col("nth") > 1)
    told = told.withColumn("problem", F.coalesce("problem", F.when(again, F.concat(F.lit('pagination loop: cursor "'), "cursor", F.lit('" repeated'))), F.when(F.col("cursor").isNotNull() & (F.col("page") >= MAX_PAGES - 1), F.lit(f"pagination did not terminate after {MAX_PAGES} pages"))))
    ends = F.col("problem").isNotNull() | F.col("cursor").isNull()
    found = told.groupBy("path").agg(F.min_by(F.struct("problem"), F.when(ends, F.col("page"))).alias("end"), F.min(F.when(ends, F.col("page"))).alias("last"))
    judged = found.select("path", "last", F.when(F.col("last").isNull(), "the capture ends while a cursor is open").otherwise(F.col("end.problem")).alias("error"))
    good = told.select("path", "page", "reply").join(unsent(judged.where("error IS NULL").select("path", "last")), "path").where("page <= last").drop("last")
    return judged.select("path", "error"), good


def mutation_word(name: Column, description: Column) -> Column:
    """The first word of the list that a tool's name or description holds, in any of its forms; null if none."""
    spaced = F.lower(F.regexp_replace(F.concat(name, F.lit(" "), F.coalesce(description, F.lit(""))), "([a-z0-9])([A-Z])", "$1 $2"))
    words = F.split(spaced, "[^a-z]+")
    return F.get(F.filter(F.array(*map(F.lit, MUTATION)), lambda w: F.arrays_overlap(words, F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("es")), F.concat(w, F.lit("d")), F.concat(w, F.lit("ed"))))), F.lit(0))


def tools_of(pages: DataFrame, tokens=approximate_tokens) -> DataFrame:
    """mcp_tool of the pages of complete listings; entries of any shape become rows. Places count on from page to page, so no server's entries are brought together."""
    listed = pages.select("path", "page", F.from_json(F.get_json_object("reply", "$.tools"), "array<string>").alias("entries"))
    before = Window.partitionBy("path").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)  # of pages, which are capped
    listed = listed.withColumn("start", F.coalesce(F.sum(F.size("entries")).over(before), F.lit(0)))
    entries = listed.select("path", "start", F.posexplode("entries").alias("at", "e")).select("path", (F.col("start") + F.col("at")).cast("int").alias("ord"), F.coalesce("e", F.lit("null")).alias("e"))
    is_object = F.startswith("e", F.lit("{"))
    name = F.coalesce(F.when(is_object, json_string(F.col("e"), "$.name")), F.lit(""))
    described = F.when(is_object, json_string(F.col("e"), "$.description"))
    schema = F.when(is_object, F.get_json_object("e", "$.inputSchema"))
    stated = F.coalesce(F.array_contains(F.json_object_keys("e"), "inputSchema"), F.lit(False))
    shaped = ~stated | F.coalesce(F.startswith(schema, F.lit("{")), F.lit(False))
    tool = entries.select("path", "ord", name.alias("name"), described.alias("description"), F.when(F.startswith(schema, F.lit("{")), schema).alias("input_schema"), (is_object & (trimmed(name) != "") & shaped).alias("entry_valid"))
    # The schema goes in as it is, not as a string; to_json leaves out what is null
    told = F.to_json(F.struct("name", "description"))
    cost = F.when(F.col("input_schema").isNull(), told).otherwise(F.concat(F.substring(told, F.lit(1), F.length(told) - 1), F.lit(',"inputSchema":'), "input_schema", F.lit("}")))
    return tool.withColumn("tokens", tokens(cost))


def server_rows(own: DataFrame, tool: DataFrame) -> DataFrame:
    """mcp_server of rows that have path, name, transport, target, initialize, initialize_error, tools_list_error and probed."""
    total = tool.groupBy("path").agg(F.sum("tokens").cast("int").alias("tokens_total"))
    return own.join(unsent(total), "path", "left").select(
        "path", "name", "transport", "target",
        F.col("initialize").isNotNull().alias("initialized"),
        "initialize_error",
        F.get_json_object("initialize", "$.protocolVersion").alias("protocol_version"),
        F.get_json_object("initialize", "$.capabilities").alias("capabilities"),
        "tools_list_error",
        F.coalesce("tokens_total", F.lit(0)).alias("tokens_total"),
        "probed",
    )


def servers(capture: DataFrame, tokens=approximate_tokens) -> tuple[DataFrame, DataFrame]:
    """(mcp_server, mcp_tool). A listing that failed has no tools; one without pages has none either, and no error."""
    pages = capture.where("initialize IS NOT NULL AND list_error IS NULL").select("path", F.posexplode("pages").alias("page", "reply"), F.lit(None).cast("string").alias("error"))
    judged, good = listings(pages)
    tool = tools_of(good, tokens)
    own = capture.join(unsent(judged), "path", "left").withColumn("tools_list_error", F.coalesce("list_error", "error"))
    return server_rows(own, tool), tool


def synthesize(schema: object) -> dict:
    """The least arguments a schema asks for."""

    def value(p: object) -> object:
        if not isinstance(p, dict):
            return "test"
        if isinstance(p.get("enum"), list) and p["enum"]:
            return p["enum"][0]
        simple = {"string": "test", "number": 1, "integer": 1, "boolean": False, "array": [], "null": None}
        kind = p.get("type") if isinstance(p.get("type"), str) else None
        if kind in simple:
            return simple[kind]
        return synthesize(p) if kind == "object" or isinstance(p.get("properties"), dict) else "test"

    if not isinstance(schema, dict):
        return {}
    props = schema.get("properties") if isinstance(schema.get("properties"), dict) else {}
    asked = schema.get("required") if isinstance(schema.get("required"), list) else []
    return {k: value(props.get(k)) for k in asked if isinstance(k, str)}


@F.pandas_udf(T.StringType())
def synthesized_args(schemas: pd.Series) -> pd.Series:
    """Least arguments of each schema, as JSON; schemas nest without bound, hence Python."""
    return pd.Series([json.dumps(synthesize(json.loads(s) if s else None)) for s in schemas])


def structured_error(content: Column) -> Column:
    """False only for a single text item that isn't JSON."""
    items = F.from_json(content, "array<string>")
    one = F.get(items, F.lit(0))
    said = json_string(one, "$.text")
    prose = (F.size(items) == 1) & (json_string(one, "$.type") == "text") & said.isNotNull() & F.try_parse_json(said).isNull()
    return ~F.coalesce(prose, F.lit(False))
