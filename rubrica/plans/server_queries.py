"""Queries over server transcripts that are derived from the part table, with their SQL.

Twenty parts are a server and each part is one of its tools. The server's number decides what its connection meets: a kind of failure for sixteen of twenty-four, none for the rest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rubrica.operators import mcp_rules
from rubrica.operators.engine import to_findings
from rubrica.operators.hits import by_row
from rubrica.sources.transcripts import replay
from rubrica.tables import table_of

KINDS = 24
#: Connections whose initialize fails, by kind.
EVENTS = {
    2: ("http", '{"name":"TypeError","message":"fetch failed"}'),
    10: ("stdio", '{"name":"Error","code":"ENOENT","message":"no such command"}'),
    14: ("stdio", '{"name":"McpError","message":"MCP error -32000: Connection closed"}'),
    15: ("http", '{"name":"UnauthorizedError","message":"Unauthorized"}'),
    16: ("http", '{"name":"Error","message":"socket hang up","cause":{"code":"ECONNRESET"}}'),
}
REFUSED, SLOW, BAD_RESULT = 1, 3, 13
NOT_STARTED = [REFUSED, SLOW, BAD_RESULT, *EVENTS]
#: Listings that fail, by kind.
PAGE_ERROR, TOOLS_OBJECT, LOOP, LATE_PAGE, CUT_OFF, ENDLESS, NO_TOOLS, BAD_CURSOR = 4, 5, 6, 7, 8, 9, 11, 12


def said(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def part_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n (server), kind, place and page of each part's tool, and its tools/list entry."""
    k = F.col("p_partkey")
    name = F.when(k % 11 == 0, "").otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), k.cast("string")))
    described = F.when(k % 5 == 1, "Deletes the part").when(k % 5 == 2, "Returns the stock").when(k % 5 == 3, "sends an order").when(k % 5 == 4, "Reads one file")
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select(k.alias("k"), F.expr("p_partkey div 20").alias("n"), (k % 20).alias("place"), name.alias("name"), described.alias("description"))
    entry = F.to_json(F.struct("name", "description", F.when(F.col("k") % 2 == 0, F.struct(F.lit("object").alias("type"))).alias("inputSchema")))
    return p.withColumns({"kind": F.col("n") % KINDS, "page": F.expr("place div 5"), "entry": entry})


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of all servers."""
    tool = part_tools(spark, sf_dir)
    kind, n = F.col("kind"), F.col("n")
    server = tool.groupBy("n", "kind").agg(F.max("page").alias("last"))
    stdio = kind.isin([k for k, (t, _) in EVENTS.items() if t == "stdio"])

    def rows(df: DataFrame, seq: Column, at: Column, sender: str, message: Column) -> DataFrame:
        target = F.when(stdio, said("/usr/bin/server-", n, " --stdio")).otherwise(said("http://Host", n, ".example:80/mcp"))
        return df.select(said("s", n).alias("path"), F.when(stdio, "stdio").otherwise("http").alias("transport"), target.alias("target"), seq.cast("long").alias("seq"), at.cast("double").alias("at_ms"), F.lit(sender).alias("sender"), message.alias("message"))

    def request(df: DataFrame, id_: Column, method: str, params: Column | str = "{}") -> DataFrame:
        return rows(df, id_ * 4, id_ * 20_000, "client", said('{"jsonrpc":"2.0","id":', id_, f',"method":"{method}","params":', params, "}"))

    def reply(df: DataFrame, id_: Column, after: Column | float, body: Column) -> DataFrame:
        return rows(df, id_ * 4 + 1, id_ * 20_000 + after, "server", said('{"jsonrpc":"2.0","id":', id_, ",", body, "}"))

    zero = F.lit(0)
    started = F.when(kind == REFUSED, '"error":{"code":-32600,"message":"bad request"}').when(kind == BAD_RESULT, '"result":{"capabilities":{}}')
    shown = F.when(kind == 0, " ").otherwise(said("server ", n))
    started = started.otherwise(said('"result":{"protocolVersion":"2025-06-18","capabilities":{"tools":{}},"serverInfo":{"name":"', shown, '","version":"1"}}'))
    event = F.lit(None).cast("string")
    for k, (_, message) in EVENTS.items():
        event = F.when(kind == k, message).otherwise(event)
    met = kind.isin(list(EVENTS))
    out = [
        request(server, zero, "initialize"),
        reply(server.where(~met), zero, F.when(kind == SLOW, 20_000).otherwise(7), started),
        rows(server.where(met), zero + 1, zero + 3, "transport", event),
        rows(server.where(kind == 0), zero + 2, zero + 9, "server", F.lit("a line that is no JSON")),
    ]
    # Pages: those with tools, and for two kinds more without any
    live = server.where(~kind.isin(NOT_STARTED))
    listed = tool.groupBy("n", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]), ",").alias("entries"))  # five of a page
    more = live.where(kind.isin(LOOP, ENDLESS)).select("n", F.explode(F.sequence(F.col("last") + 1, F.col("last") + F.when(kind == LOOP, 1).otherwise(100))).alias("page"), F.lit("").alias("entries"))
    pages = listed.union(more).join(live, "n")
    is_last = F.col("page") == F.col("last")
    cursor = F.when((kind == BAD_CURSOR) & is_last, ',"nextCursor":7').when((F.col("page") > F.col("last")) & (kind == LOOP), said(',"nextCursor":"c', F.col("last"), '"'))
    cursor = cursor.when((F.col("page") != F.col("last")) | kind.isin(LOOP, CUT_OFF, ENDLESS), said(',"nextCursor":"c', F.col("page"), '"')).otherwise("")
    body = F.when(is_last & (kind == PAGE_ERROR), '"error":{"code":-32603,"message":"no such page"}').when(is_last & (kind == TOOLS_OBJECT), '"result":{"tools":{"a":1}}').when(is_last & (kind == NO_TOOLS), '"result":{"other":[]}')
    body = body.otherwise(said('"result":{"tools":[', F.col("entries"), "]", cursor, "}"))
    page_id = F.col("page") + 1
    out += [
        request(pages, page_id, "tools/list", F.when(F.col("page") == 0, "{}").otherwise(said('{"cursor":"c', F.col("page") - 1, '"}'))),
        reply(pages, page_id, F.when(is_last & (kind == LATE_PAGE), 12_000).otherwise(5), body),
        rows(pages.where(kind == 17), page_id * 4 + 2, page_id * 20_000 + 6, "server", said('{"jsonrpc":"2.0","id":', page_id, ',"result":{}}')),  # a second reply
    ]
    # Calls of named tools; what they come to follows from the part's key
    k = F.col("k")
    called = tool.where((k % 11 != 0) & (k % 9 != 7) & ~kind.isin(NOT_STARTED))
    call_id = F.col("place") + 500
    told = F.when(k % 9 == 1, '"error":{"code":-32602,"message":"bad arguments"}').when(k % 9 == 2, '"result":{"isError":true,"content":[{"type":"text","text":"it broke"}]}').when(k % 9 == 3, '"result":{"isError":true,"content":[{"type":"text","text":"{}"}]}')
    told = told.when(k % 9 == 6, '"result":{"content":"x"}').when(k % 9 == 8, '"result":{"isError":true,"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}').otherwise('"result":{"content":[{"type":"text","text":"fine"}]}')
    out += [
        request(called, call_id, "tools/call", said('{"name":"', F.col("name"), '","arguments":{}}')),
        reply(called.where(k % 9 != 5), call_id, F.when(k % 9 == 4, 10_001.0).otherwise(k * 7 % 6000 + 10.4), told),
    ]
    return table_of(reduce(DataFrame.union, out), "transcripts")  # as a captured table would be


def replayed_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each connection came to: its failure, or its server with the number of its tools."""
    r = replay(transcripts(spark, sf_dir))
    tools = r.tools.groupBy("path").agg(F.count(F.lit(1)).alias("tools"), F.count(F.when(~F.col("entry_valid"), 1)).alias("invalid"))
    graded = r.servers.join(tools, "path", "left").select("path", "name", F.lit(None).cast("string").alias("failure"), "initialized", "protocol_version", F.coalesce("initialize_error", "tools_list_error").alias("error"), F.coalesce("tools", F.lit(0)).alias("tools"), F.coalesce("invalid", F.lit(0)).alias("invalid"), F.col("tokens_total").cast("long").alias("tokens_total"))
    null = lambda kind: F.lit(None).cast(kind)
    return graded.union(r.unreachable.select("path", null("string"), "failure", null("boolean"), null("string"), "error", null("long"), null("long"), null("long")))


def replayed_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tools of all complete listings, in their places."""
    return replay(transcripts(spark, sf_dir)).tools.select("path", "ord", "name", "description", "input_schema", "entry_valid", "tokens")


def replayed_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What probing each tool came to."""
    return replay(transcripts(spark, sf_dir), probe=True).probes.select("path", "ord", "tool_name", "skipped", "skip_reason", "latency_ms", "protocol_error", "error_structured")


def replayed_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of MCP401, MCP402 and MCP403 from the replayed probes."""
    probes = replay(transcripts(spark, sf_dir), probe=True).probes
    hits = by_row(probes, mcp_rules.TYPE, mcp_rules.probe_rules()).unionByName(mcp_rules.latency(probes, 5000))
    return to_findings(hits).select("path", "rule_id", "severity", "tool_name", "message")


_PARTS_SQL = """
t AS (SELECT p_partkey AS k, p_partkey // 20 AS n, (p_partkey // 20) % 24 AS kind, p_partkey % 20 AS place, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE replace(p_name, ' ', '_') || '_' || p_partkey END AS name,
    [NULL, 'Deletes the part', 'Returns the stock', 'sends an order', 'Reads one file'][p_partkey % 5 + 1] AS d, CASE WHEN p_partkey % 2 = 0 THEN '{"type":"object"}' END AS schema FROM part),
u AS (SELECT *, '{"name":"' || name || '"' || coalesce(',"description":"' || d || '"', '') || coalesce(',"inputSchema":' || schema, '') || '}' AS cost FROM t),
s AS (SELECT n, kind, max(place // 5) AS last, count(*) AS tools, count(*) FILTER (name = '') AS invalid, sum(ceil(strlen(cost) / 4))::BIGINT AS tokens FROM u GROUP BY n, kind),
complete AS (SELECT * FROM u WHERE kind = 0 OR kind > 16)"""
REPLAYED_SERVERS_SQL = f"""WITH {_PARTS_SQL},
e AS (SELECT *, CASE WHEN kind IN (10, 14) THEN '/usr/bin/server-' || n || ' --stdio' ELSE 'http://Host' || n || '.example:80/mcp' END AS target FROM s)
SELECT 's' || n AS path, CASE WHEN kind IN (2, 3, 10, 15, 16) THEN NULL WHEN kind = 14 THEN 'server-' || n WHEN kind IN (0, 1, 13) THEN 'host' || n || '.example:80' ELSE 'server ' || n END AS name,
    CASE kind WHEN 2 THEN 'network' WHEN 16 THEN 'network' WHEN 10 THEN 'spawn' WHEN 15 THEN 'auth' WHEN 3 THEN 'timeout' END AS failure,
    CASE WHEN kind IN (2, 3, 10, 15, 16) THEN NULL ELSE kind NOT IN (1, 13, 14) END AS initialized,
    CASE WHEN kind NOT IN (1, 2, 3, 10, 13, 14, 15, 16) THEN '2025-06-18' END AS protocol_version,
    CASE kind WHEN 1 THEN 'MCP error -32600: bad request' WHEN 2 THEN 'cannot reach MCP server ' || target || ': fetch failed' WHEN 3 THEN 'timed out connecting to MCP server after 15000ms: ' || target
        WHEN 4 THEN 'MCP error -32603: no such page' WHEN 5 THEN 'tools/list result: tools is not an array' WHEN 6 THEN 'pagination loop: cursor "c' || last || '" repeated' WHEN 7 THEN 'MCP error -32001: Request timed out'
        WHEN 8 THEN 'the capture ends while a cursor is open' WHEN 9 THEN 'pagination did not terminate after 100 pages' WHEN 10 THEN 'cannot reach MCP server ' || target || ': no such command' WHEN 11 THEN 'tools/list result has no tools array'
        WHEN 12 THEN 'tools/list result: nextCursor is not a string' WHEN 13 THEN 'initialize result is malformed' WHEN 14 THEN 'MCP error -32000: Connection closed' WHEN 15 THEN 'cannot reach MCP server ' || target || ': Unauthorized'
        WHEN 16 THEN 'cannot reach MCP server ' || target || ': socket hang up' END AS error,
    CASE WHEN kind IN (2, 3, 10, 15, 16) THEN NULL WHEN kind = 0 OR kind > 16 THEN tools ELSE 0 END AS tools, CASE WHEN kind IN (2, 3, 10, 15, 16) THEN NULL WHEN kind = 0 OR kind > 16 THEN invalid ELSE 0 END AS invalid,
    CASE WHEN kind IN (2, 3, 10, 15, 16) THEN NULL WHEN kind = 0 OR kind > 16 THEN tokens ELSE 0 END AS tokens_total FROM e"""
REPLAYED_TOOLS_SQL = f"WITH {_PARTS_SQL} SELECT 's' || n AS path, place::INT AS ord, name, d AS description, schema AS input_schema, name <> '' AS entry_valid, ceil(strlen(cost) / 4)::INT AS tokens FROM complete"
_PROBES_SQL = f"""{_PARTS_SQL},
w AS (SELECT *, list_distinct(regexp_split_to_array(lower(name || ' ' || coalesce(d, '')), '[^a-z]+')) AS words FROM complete),
m AS (SELECT *, CASE WHEN list_has_any(words, ['deletes']) THEN 'delete' WHEN list_has_any(words, ['sends']) THEN 'send' WHEN list_has_any(words, ['set', 'sets', 'order', 'orders', 'post', 'message', 'put', 'push', 'patch', 'drop', 'write', 'create', 'update']) THEN 'other' END AS word FROM w),
r AS (SELECT *, CASE WHEN name = '' THEN 'invalid tool entry (see MCP002)' WHEN word IS NOT NULL THEN 'mutation-keyword: ' || word WHEN k % 9 = 7 THEN 'no call in the transcript' END AS why FROM m),
probe AS (SELECT 's' || n AS path, place::INT AS ord, CASE WHEN name = '' THEN '(unnamed tool)' ELSE name END AS tool_name, why IS NOT NULL AS skipped, why AS skip_reason,
    CASE WHEN why IS NULL THEN (CASE WHEN k % 9 IN (4, 5) THEN 10000 ELSE k * 7 % 6000 + 10 END)::INT END AS latency_ms, CASE WHEN why IS NULL THEN k % 9 IN (1, 4, 5, 6) END AS protocol_error,
    CASE WHEN why IS NULL AND k % 9 IN (2, 3, 8) THEN k % 9 <> 2 END AS error_structured FROM r)"""
REPLAYED_PROBES_SQL = f"WITH {_PROBES_SQL} SELECT * FROM probe"
RELIABILITY_SQL = f"""WITH {_PROBES_SQL}, p AS (SELECT path, quantile_disc(latency_ms, 0.95) AS p, count(latency_ms) AS n FROM probe WHERE NOT skipped GROUP BY path)
SELECT path, 'MCP401' AS rule_id, 'warn' AS severity, tool_name, 'probe call to "' || tool_name || '" failed at the protocol level despite schema-valid arguments' AS message FROM probe WHERE protocol_error
UNION ALL SELECT path, 'MCP403', 'warn', tool_name, '"' || tool_name || '" reports errors as a bare text blob with no machine-readable structure' FROM probe WHERE error_structured = false
UNION ALL SELECT path, 'MCP402', 'info', NULL, 'p95 latency across ' || n || ' probed tool' || CASE n WHEN 1 THEN '' ELSE 's' END || ' is ' || p || 'ms (budget: 5000ms)' FROM p WHERE p > 5000"""

QUERIES = {"replayed_servers": replayed_servers, "replayed_tools": replayed_tools, "replayed_probes": replayed_probes, "replayed_reliability": replayed_reliability}
ORACLE_SQL = {"replayed_servers": REPLAYED_SERVERS_SQL, "replayed_tools": REPLAYED_TOOLS_SQL, "replayed_probes": REPLAYED_PROBES_SQL, "replayed_reliability": RELIABILITY_SQL}
