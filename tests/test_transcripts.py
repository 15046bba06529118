import json

from rubrica.sources import mcp as M
from rubrica.sources import transcripts as T
from rubrica.operators import mcp_rules
from rubrica.config import Config
from rubrica.operators.catalog import RULES

HELLO = {"protocolVersion": "2025-06-18", "capabilities": {"tools": {}}, "serverInfo": {"name": "srv", "version": "1"}}


class Connection:
    """Writes the messages of one connection."""

    def __init__(self, path="s", transport="http", target="http://Host.example:80/mcp"):
        self.head, self.rows, self.seq, self.at, self.id = (path, transport, target), [], 0, 0.0, 0

    def add(self, sender, message):
        self.rows.append((*self.head, self.seq, self.at, sender, message if isinstance(message, str) else json.dumps(message)))
        self.seq += 1

    def call(self, method, reply=None, after=5.0, params=None, raw=False):
        """A request and, unless reply is None, what the server sends back `after` so many ms."""
        own, self.id = self.id, self.id + 1
        self.add("client", {"jsonrpc": "2.0", "id": own, "method": method, "params": params or {}})
        self.at += after
        if reply is not None:
            self.add("server", reply if raw else {"jsonrpc": "2.0", "id": own, **reply})
        return self

    def hello(self, result=HELLO, after=5.0):
        return self.call("initialize", {"result": result}, after)

    def pages(self, *results):
        for r in results:
            self.call("tools/list", r if "error" in r else {"result": r})
        return self

    def broke(self, **error):
        self.add("transport", error)
        return self


def replayed(spark, *connections, **more):
    df = spark.createDataFrame([r for c in connections for r in c.rows], T.MESSAGES)
    return T.replay(df, **more)


def outcomes(spark, connections):
    """What each connection came to, in one replay: (failure, error, hint), or (initialized, initialize_error, tools_list_error, tools)."""
    for i, c in enumerate(connections):
        c.rows = [(f"c{i:03}", *r[1:]) for r in c.rows]
    r = replayed(spark, *connections)
    out = {u.path: (u.failure, u.error, u.hint) for u in r.unreachable.collect()}
    n = {t["path"]: t["count"] for t in r.tools.groupBy("path").count().collect()}
    served = {s.path: (s.initialized, s.initialize_error, s.tools_list_error, n.get(s.path, 0)) for s in r.servers.collect()}
    assert not out.keys() & served.keys() and len(out) + len(served) == len(connections)
    out |= served
    return [out[f"c{i:03}"] for i in range(len(connections))]


def test_what_connections_come_to(spark):
    http = "http://Host.example:80/mcp"
    web = lambda **e: Connection().call("initialize", after=1).broke(**e)
    shell = lambda **e: Connection("p", "stdio", "/bin/srv -x").call("initialize", after=1).broke(**e)
    cannot = lambda kind, said, target=http: lambda o: o[:2] == (kind, f"cannot reach MCP server {target}: {said}")
    late = lambda o: o[:2] == ("timeout", f"timed out connecting to MCP server after 15000ms: {http}")
    noise = Connection()
    noise.add("server", "no json")
    cases = [
        # No server is met
        (web(name="TypeError", message="fetch failed"), cannot("network", "fetch failed")),
        (web(name="UnauthorizedError", message="no"), cannot("auth", "no")),
        (web(name="StreamableHTTPError", message="404"), cannot("auth", "404")),
        (web(message="x", cause={"code": "ECONNRESET"}), cannot("network", "x")),
        (web(message="x", cause={"message": "getaddrinfo ENOTFOUND h"}), cannot("network", "x")),
        (web(message="self-signed certificate"), cannot("network", "self-signed certificate")),
        (shell(code="ENOENT", message="x"), cannot("spawn", "x", "/bin/srv -x")),
        (shell(code="EPERM", message="x"), lambda o: "executable" in o[2]),
        (shell(message="spawn /bin/srv EACCES"), cannot("spawn", "spawn /bin/srv EACCES", "/bin/srv -x")),
        (Connection().hello(after=15_001.0), late),
        (Connection().call("initialize"), late),
        (noise, late),
        # What only counts for the other transport is graded, and so is a server that starts wrongly
        (shell(message="fetch failed"), (False, "fetch failed", None, 0)),
        (web(code="ENOENT", message="x"), (False, "x", None, 0)),
        (web(message="MCP error -32000: Connection closed"), (False, "MCP error -32000: Connection closed", None, 0)),
        (Connection().call("initialize", {"error": {"code": -32600, "message": "no"}}), (False, "MCP error -32600: no", None, 0)),
        *[(Connection().hello(bad), (False, "initialize result is malformed", None, 0)) for bad in ({}, {**HELLO, "capabilities": None}, {**HELLO, "protocolVersion": 3}, {**HELLO, "serverInfo": "x"})],
        (Connection().hello(after=15_000.0).pages({"tools": []}), (True, None, None, 0)),
    ]
    one = {"tools": [{"name": "a"}]}
    hundred = [{**one, "nextCursor": str(i)} for i in range(99)]
    listed = [
        (({**one, "nextCursor": ""}, {**one, "nextCursor": "x"}, one), None, 3),  # an empty cursor is one
        (({**one, "nextCursor": ""}, {**one, "nextCursor": ""}, one), 'pagination loop: cursor "" repeated', 0),
        (({**one, "nextCursor": "x"}, {"tools": {"a": 1}}), "tools/list result: tools is not an array", 0),
        (({**one, "nextCursor": "x"}, {}), "tools/list result has no tools array", 0),
        (({"tools": None},), "tools/list result has no tools array", 0),
        (({**one, "nextCursor": 3},), "tools/list result: nextCursor is not a string", 0),
        (({**one, "nextCursor": None},), "tools/list result: nextCursor is not a string", 0),
        (({**one, "nextCursor": "x"},), "the capture ends while a cursor is open", 0),
        (({**one, "nextCursor": "x"}, {"error": {"code": 1, "message": "m"}}), "MCP error 1: m", 0),
        ((one, {"tools": {}}), None, 1),  # what comes after the end isn't asked for
        ((*hundred, one), None, 100),
        ((*hundred, {**one, "nextCursor": "z"}, one), "pagination did not terminate after 100 pages", 0),
        ((), "the capture has no tools/list request", 0),
    ]
    cases += [(Connection().hello().pages(*pages), (True, None, error, n)) for pages, error, n in listed]
    cases += [
        (Connection().hello().call("tools/list", {"result": one}, 10_001.0), (True, None, "MCP error -32001: Request timed out", 0)),
        (Connection().hello().call("tools/list", "not json", raw=True).pages(one), (True, None, "MCP error -32001: Request timed out", 0)),
        (Connection().hello().call("tools/list", after=3).broke(message="socket closed"), (True, None, "socket closed", 0)),
    ]
    for i, (got, (_, want)) in enumerate(zip(outcomes(spark, [c for c, _ in cases]), cases, strict=True)):
        assert want(got) if callable(want) else got == want, (i, got)


def test_entries_of_any_shape(spark):
    entries = [3, None, [], {"name": 4}, {"name": " "}, {"name": "x", "inputSchema": None}, {"name": "y", "inputSchema": [1]}, {"name": "z", "description": 5, "inputSchema": {"b": 1, "a": 2}}]
    r = replayed(spark, Connection().hello().pages({"tools": entries[:5], "nextCursor": "n"}, {"tools": entries[5:]}))
    got = [(t.ord, t.name, t.description, t.input_schema, t.entry_valid) for t in r.tools.orderBy("ord").collect()]
    assert got == [(0, "", None, None, False), (1, "", None, None, False), (2, "", None, None, False), (3, "", None, None, False), (4, " ", None, None, False), (5, "x", None, None, False), (6, "y", None, None, False), (7, "z", None, '{"b":1,"a":2}', True)] or got[7][3].replace(" ", "") == '{"b":1,"a":2}'


def test_names(spark):
    blank = {**HELLO, "serverInfo": {"name": "  "}}
    cs = [Connection("a").hello(), Connection("b").hello(blank), Connection("c", "stdio", "/opt/bin/my-server --port 3").hello(blank), Connection("d", "http", "nonsense").hello(blank)]
    assert [s.name for s in replayed(spark, *cs).servers.orderBy("path").collect()] == ["srv", "host.example:80", "my-server", "nonsense"]


def test_probes(spark):
    fine, text = {"content": [{"type": "text", "text": "ok"}]}, lambda t: {"type": "text", "text": t}
    tools = [{"name": n} for n in ("read", "read", "slow", "mute", "shape", "prose", "parsed", "two", "odd", "uncalled")] + [{"name": "deleteAll"}, {"name": ""}, {"name": "bad", "inputSchema": 3}, {"name": "x", "description": "Sends mail"}]
    c = Connection().hello().pages({"tools": tools})
    go = lambda name, reply, after=4.6: c.call("tools/call", reply, after, {"name": name})
    go("read", {"result": fine}), go("read", {"error": {"code": 1, "message": "m"}}), go("slow", {"result": fine}, 10_000.5), go("mute", None), go("shape", {"result": {"content": "x"}})
    go("prose", {"result": {"isError": True, "content": [text("it broke")]}}), go("parsed", {"result": {"isError": True, "content": [text("{}")]}}), go("two", {"result": {"isError": True, "content": [text("a"), text("b")]}}), go("odd", {"result": {"content": [{"type": "text"}]}})
    r = replayed(spark, c, probe=True)
    got = [(p.tool_name, p.skipped, p.skip_reason, p.latency_ms, p.protocol_error, p.error_structured) for p in r.probes.orderBy("ord").collect()]
    assert got == [
        ("read", False, None, 5, False, None), ("read", False, None, 5, True, None), ("slow", False, None, 10_000, True, None), ("mute", False, None, 10_000, True, None), ("shape", False, None, 5, True, None),
        ("prose", False, None, 5, False, False), ("parsed", False, None, 5, False, True), ("two", False, None, 5, False, True), ("odd", False, None, 5, True, None), ("uncalled", True, "no call in the transcript", None, None, None),
        ("deleteAll", True, "mutation-keyword: delete", None, None, None), ("(unnamed tool)", True, "invalid tool entry (see MCP002)", None, None, None), ("bad", True, "invalid tool entry (see MCP002)", None, None, None), ("x", True, "mutation-keyword: send", None, None, None),
    ]
    unsafe = T.probe_results(r.exchanges, r.tools, unsafe=True).where("tool_name = 'deleteAll'").first()
    assert unsafe.skip_reason == "no call in the transcript"
    off = {rule: "off" for rule in RULES if not rule.startswith("MCP4")}
    hits = {(h.rule_id, h.tool_name) for h in mcp_rules.mcp_hits(r.servers, r.tools, r.probes, Config(rules=off)).collect()}
    assert hits == {("MCP401", n) for n in ("read", "slow", "mute", "shape", "odd")} | {("MCP403", "prose"), ("MCP402", None)}


def test_a_failed_listing_is_not_probed(spark):
    c = Connection().hello().pages({"tools": 3}).call("tools/call", {"result": {}}, params={"name": "a"})
    r = replayed(spark, c, probe=True)
    assert r.probes.count() == 0 and r.servers.first().probed


def test_many_connections_and_noise(spark, tmp_path):
    cs = [Connection(f"s{i}").hello().pages({"tools": [{"name": f"t{i}"}]}) for i in range(5)]
    for c in cs:  # second replies, replies to nobody, a request of the server's own, notifications
        c.add("server", {"id": 1, "result": {"tools": []}}), c.add("server", {"id": 77, "result": {}}), c.add("server", {"id": 0, "method": "ping"}), c.add("client", {"method": "notifications/initialized"})
    rows = [dict(zip(("path", "transport", "target", "seq", "at_ms", "sender", "message"), r, strict=True)) for c in cs for r in c.rows]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, reversed(rows))))
    r = T.replay(T.read_transcripts(spark, str(tmp_path)))
    assert sorted(t.name for t in r.tools.collect()) == [f"t{i}" for i in range(5)] and r.servers.where("initialized").count() == 5
    none = T.replay(spark.createDataFrame([], T.MESSAGES), probe=True)
    assert [x.count() for x in none] == [0, 0, 0, 0, 0]


def test_captured_pages_that_are_malformed(spark):
    good = '{"tools":[{"name":"a"}],"nextCursor":"1"}'
    cases = [([good, "not json"], "tools/list result is not JSON", 0), ([good, '{"tools":{"a":1}}'], "tools/list result: tools is not an array", 0), ([good, '{"tools":[1]'], "tools/list result is not JSON", 0), ([good], "the capture ends while a cursor is open", 0), ([good, '{"tools":[]}'], None, 1), ([], None, 0)]
    rows = [(str(i), "m", "http", "http://h", '{"protocolVersion":"1"}', None, pages, None, False) for i, (pages, *_) in enumerate(cases)]
    server, tool = M.servers(spark.createDataFrame(rows, "path string, name string, transport string, target string, initialize string, initialize_error string, pages array<string>, list_error string, probed boolean"))
    n = {t["path"]: t["count"] for t in tool.groupBy("path").count().collect()}
    assert [(s.tools_list_error, n.get(s.path, 0)) for s in server.orderBy("path").collect()] == [(e, k) for _, e, k in cases]
