"""MCP servers replayed from transcripts of their connections: initialise, tools/list with its cursors, and probe calls. No server is ever launched or called.

message: path, transport (stdio or http), target, seq, at_ms, sender (client, server or transport), message. A row is one JSON-RPC message, or an error that the transport met,
as JSON (name, code, message, cause). A path is one connection; its messages are in the order of seq, and at_ms is when each was sent or came.

Requests meet replies by path and id in a join: the first reply after a request counts, if it came within the deadline. A missing or late one is a timeout. What follows from a
reply is decided on its row, so a server with many messages is spread over tasks; only its pages, which are capped, and the calls of one tool's name are put in order.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rubrica.config import Config
from rubrica.functions.text import approximate_tokens, trimmed
from rubrica.operators.mcp_rules import json_string
from rubrica.sources.mcp import listings, mutation_word, server_rows, structured_error, tools_of
from rubrica.tables import table_of

MESSAGES = "path string, transport string, target string, seq long, at_ms double, sender string, message string"
# Deadlines, and the errors of a transport that mean no server was reached.
LIST_TIMEOUT_MS = PROBE_TIMEOUT_MS = 10_000
SPAWN_CODES = ["ENOENT", "EACCES", "EPERM"]
SPAWN = r"(?i)\bspawn\b"
HTTP_NAMES = ["UnauthorizedError", "StreamableHTTPError"]
NETWORK = r"(?i)fetch failed|ECONNREFUSED|ECONNRESET|ENOTFOUND|EAI_AGAIN|certificate"
CAUSE = r"(?i)ECONNREFUSED|ENOTFOUND|ECONNRESET|EAI_AGAIN"
HINTS = {
    "timeout": "check that the server starts and speaks MCP; raise budgets.mcpConnectTimeoutMs if it is just slow",
    "stdio": "check that the command exists and is executable",
    "http": "check the URL, network access, and any required auth headers",
}
TIMED_OUT = "MCP error -32001: Request timed out"
CONTENT_KINDS = ["text", "image", "audio", "resource", "resource_link"]


class Replay(NamedTuple):
    servers: DataFrame  #: mcp_server
    tools: DataFrame  #: mcp_tool
    probes: DataFrame  #: mcp_probe; no row without probing
    unreachable: DataFrame  #: path, transport, target, failure, error, hint: connections that never met a speaking server, which aren't graded
    exchanges: DataFrame  #: a table in the shared folder that the others are read from; drop_table deletes it


def read_transcripts(spark: SparkSession, location: str) -> DataFrame:
    """Messages from JSON lines at any location that Spark reads."""
    return spark.read.schema(MESSAGES).json(location)


def unreachable_kind(transport: Column, error: Column) -> Column:
    """Which failure a transport's error is (spawn, auth, network), if it means that no server was reached; null if the server is to be graded."""
    name, code, said = (F.coalesce(json_string(error, f"$.{k}"), F.lit("")) for k in ("name", "code", "message"))
    cause = F.coalesce(F.get_json_object(error, "$.cause.code"), F.get_json_object(error, "$.cause.message"), F.lit(""))
    stdio = F.when(code.isin(SPAWN_CODES) | said.rlike(SPAWN), "spawn")
    http = F.when(name.isin(HTTP_NAMES), "auth").when(said.rlike(NETWORK) | cause.rlike(CAUSE), "network")
    return F.when(transport == "stdio", stdio).otherwise(http)


def exchanges(messages: DataFrame, connect_ms: float) -> DataFrame:
    """A row for each request of a client: path, seq, method, message, came (ms until the reply, or until the failure), result (JSON), error (null if there is a result), broken (whether the transport failed it).

    Of requests that share an id the first counts. Replies without a request, with neither result nor error, and lines that aren't JSON are passed over.
    """
    own = messages.select("path", "seq", "at_ms", "sender", "message", F.get_json_object("message", "$.id").alias("id"), F.get_json_object("message", "$.method").alias("method"))
    asked = own.where("sender = 'client' AND id IS NOT NULL AND method IS NOT NULL").groupBy("path", "id").agg(F.min_by(F.struct("seq", "at_ms", "method", "message"), "seq").alias("q")).select("path", "id", "q.*")
    result, failed = F.get_json_object("message", "$.result"), F.get_json_object("message", "$.error")
    said = F.concat(F.lit("MCP error "), F.coalesce(F.get_json_object("message", "$.error.code"), F.lit("")), F.lit(": "), F.coalesce(F.get_json_object("message", "$.error.message"), F.lit("")))
    answers = own.where("sender = 'server' AND id IS NOT NULL AND method IS NULL").select("path", "id", F.col("seq").alias("r_seq"), F.col("at_ms").alias("r_at"), result.alias("result"), F.when(failed.isNotNull(), said).alias("error")).where("result IS NOT NULL OR error IS NOT NULL")
    limit = F.when(F.col("method") == "initialize", F.lit(float(connect_ms))).when(F.col("method") == "tools/call", F.lit(float(PROBE_TIMEOUT_MS))).otherwise(F.lit(float(LIST_TIMEOUT_MS)))
    in_time = answers.join(asked.select("path", "id", "seq", "at_ms", limit.alias("limit")), ["path", "id"]).where("r_seq > seq AND r_at - at_ms <= limit")
    first = in_time.groupBy("path", "id").agg(F.min_by(F.struct("r_seq", "r_at", "result", "error"), "r_seq").alias("r"))
    # A transport's first error fails what is open then, and all that follows
    broke = messages.where("sender = 'transport'").groupBy("path").agg(F.min_by(F.struct(F.col("seq").alias("seq"), F.col("at_ms").alias("at"), F.coalesce(json_string(F.col("message"), "$.message"), F.lit("Connection closed")).alias("said")), "seq").alias("b"))
    all_ = asked.withColumn("limit", limit).join(first, ["path", "id"], "left").join(broke, "path", "left")
    open_ = F.coalesce(F.col("r.r_seq") > F.col("b.seq"), F.col("r").isNull())
    broken = F.coalesce(F.col("b.seq").isNotNull() & open_ & (F.col("b.at") - F.col("at_ms") <= F.col("limit")), F.lit(False))
    came = F.when(broken, F.greatest(F.col("b.at") - F.col("at_ms"), F.lit(0.0))).when(F.col("r").isNull(), F.col("limit")).otherwise(F.col("r.r_at") - F.col("at_ms"))
    error = F.when(broken, F.col("b.said")).when(F.col("r").isNull(), TIMED_OUT).otherwise(F.col("r.error"))
    return all_.select("path", "seq", "method", "message", came.alias("came"), F.when(error.isNull(), F.col("r.result")).alias("result"), error.alias("error"), broken.alias("broken"))


def connections(messages: DataFrame, told: DataFrame, connect_ms: float) -> DataFrame:
    """A row for each path: name, transport, target, initialize (JSON, null if it failed), initialize_error, failure (null if a speaking server was reached)."""
    paths = messages.groupBy("path").agg(F.min_by("transport", "seq").alias("transport"), F.min_by("target", "seq").alias("target"), F.min_by(F.when(F.col("sender") == "transport", F.col("message")), F.when(F.col("sender") == "transport", F.col("seq"))).alias("broke"))
    started = told.where("method = 'initialize'").groupBy("path").agg(F.min_by(F.struct("result", "error", "broken"), "seq").alias("i"))
    own = paths.join(started, "path", "left")
    event = F.coalesce(F.col("i.broken"), F.col("i").isNull() & F.col("broke").isNotNull())
    failure = F.when(event, unreachable_kind(F.col("transport"), F.col("broke"))).when(F.col("i").isNull() | (F.col("i.error") == TIMED_OUT), "timeout")
    result = F.col("i.result")
    shaped = json_string(result, "$.protocolVersion").isNotNull() & F.coalesce(F.startswith(F.get_json_object(result, "$.capabilities"), F.lit("{")), F.lit(False)) & F.coalesce(F.startswith(F.get_json_object(result, "$.serverInfo"), F.lit("{")), F.lit(False))
    given = json_string(result, "$.serverInfo.name")
    host = F.regexp_extract("target", "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]+)", 1)
    fallback = F.when(F.col("transport") == "http", F.when(host == "", F.col("target")).otherwise(F.lower(host))).otherwise(F.element_at(F.split(F.regexp_replace(F.split("target", " ")[0], "/+$", ""), "/"), -1))
    why = F.coalesce(F.when(event, F.coalesce(json_string(F.col("broke"), "$.message"), F.lit("Connection closed"))), F.col("i.error"), F.when(~shaped, F.lit("initialize result is malformed")))
    good = why.isNull() & failure.isNull()
    return own.select(
        "path",
        F.coalesce(F.when(good & (trimmed(given) != ""), given), fallback).alias("name"),
        "transport",
        "target",
        F.when(good, result).alias("initialize"),
        F.when(failure.isNull(), why).alias("initialize_error"),
        failure.alias("failure"),
        why.alias("why"),
    )


def unreachable(conn: DataFrame, connect_ms: float) -> DataFrame:
    late = F.col("failure") == "timeout"
    error = F.when(late, F.concat(F.lit(f"timed out connecting to MCP server after {connect_ms:g}ms: "), "target")).otherwise(F.concat(F.lit("cannot reach MCP server "), "target", F.lit(": "), "why"))
    hint = F.when(late, HINTS["timeout"]).when(F.col("transport") == "stdio", HINTS["stdio"]).otherwise(HINTS["http"])
    return conn.where("failure IS NOT NULL").select("path", "transport", "target", "failure", error.alias("error"), hint.alias("hint"))


def listed_pages(told: DataFrame, reached: DataFrame) -> DataFrame:
    """Pages of listings(); a server that was never asked for its tools has one failed page."""
    asked = told.where("method = 'tools/list'").withColumn("page", F.row_number().over(Window.partitionBy("path").orderBy("seq")) - 1).select("path", "page", F.col("result").alias("reply"), "error")
    none = reached.select("path").join(asked.select("path").distinct(), "path", "left_anti").select("path", F.lit(0).alias("page"), F.lit(None).cast("string").alias("reply"), F.lit("the capture has no tools/list request").alias("error"))
    return asked.join(reached.select("path"), "path", "left_semi").union(none)


def call_shaped(result: Column) -> Column:
    """Whether a tools/call result has the shape it must have: content, if any, a list of items of known kinds, and isError, if any, a boolean."""
    content, flag = F.get_json_object(result, "$.content"), F.get_json_object(result, "$.isError")
    kind = lambda e: F.coalesce(json_string(e, "$.type"), F.lit(""))
    item = lambda e: F.coalesce(F.startswith(e, F.lit("{")) & kind(e).isin(CONTENT_KINDS) & ((kind(e) != "text") | json_string(e, "$.text").isNotNull()), F.lit(False))
    listed = content.isNull() | (F.startswith(content, F.lit("[")) & F.forall(F.from_json(content, "array<string>"), item))
    return F.startswith(result, F.lit("{")) & listed & (flag.isNull() | flag.isin("true", "false"))


def probe_results(told: DataFrame, tools: DataFrame, unsafe: bool = False) -> DataFrame:
    """mcp_probe with ord: what each tool's call came to, or why it wasn't made. The k-th call under a name is the k-th callable tool's of that name."""
    named = F.when(trimmed(F.col("name")) == "", "(unnamed tool)").otherwise(F.col("name"))
    word = mutation_word(F.col("name"), F.col("description"))
    reason = F.when(~F.col("entry_valid"), "invalid tool entry (see MCP002)")
    if not unsafe:
        reason = reason.when(word.isNotNull(), F.concat(F.lit("mutation-keyword: "), word))
    own = tools.select("path", "ord", named.alias("tool_name"), reason.alias("skip_reason"))
    nth = F.row_number().over(Window.partitionBy("path", "tool_name").orderBy("ord"))
    live = own.where("skip_reason IS NULL").withColumn("nth", nth)
    calls = told.where("method = 'tools/call'").withColumn("tool_name", F.get_json_object("message", "$.params.name"))
    calls = calls.withColumn("nth", F.row_number().over(Window.partitionBy("path", "tool_name").orderBy("seq"))).select("path", "tool_name", "nth", "came", "result", "error")
    bad = F.col("error").isNotNull() | ~F.coalesce(call_shaped(F.col("result")), F.lit(False))
    failed = ~bad & (F.get_json_object("result", "$.isError") == "true")
    uncalled = F.col("came").isNull()
    done = live.join(calls, ["path", "tool_name", "nth"], "left").select(
        "path", "ord", "tool_name", uncalled.alias("skipped"), F.when(uncalled, "no call in the transcript").alias("skip_reason"),
        F.floor(F.col("came") + 0.5).cast("int").alias("latency_ms"), F.when(~uncalled, bad).alias("protocol_error"),
        F.when(failed, F.coalesce(structured_error(F.get_json_object("result", "$.content")), F.lit(True))).alias("error_structured"),
    )
    null = lambda kind: F.lit(None).cast(kind)
    skipped = own.where("skip_reason IS NOT NULL").select("path", "ord", "tool_name", F.lit(True).alias("skipped"), "skip_reason", null("int").alias("latency_ms"), null("boolean").alias("protocol_error"), null("boolean").alias("error_structured"))
    return done.union(skipped)


def replay(messages: DataFrame, config: Config | None = None, probe: bool = False, unsafe: bool = False, tokens=approximate_tokens) -> Replay:
    """What the connections of a transcript came to. probe: whether calls were made; the tools of a listing that failed weren't called."""
    connect_ms = (config or Config()).budgets.mcpConnectTimeoutMs
    told = table_of(exchanges(messages, connect_ms), "exchanges")
    conn = connections(messages, told, connect_ms)
    reached = conn.where("initialize IS NOT NULL")
    judged, good = listings(listed_pages(told, reached))
    tools = tools_of(good, tokens)
    own = conn.where("failure IS NULL").join(judged, "path", "left").withColumnRenamed("error", "tools_list_error").withColumn("probed", F.lit(probe))
    probes = probe_results(told, tools, unsafe)
    return Replay(server_rows(own, tools), tools, probes if probe else probes.where(F.lit(False)), unreachable(conn, connect_ms), told)
