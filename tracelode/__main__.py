"""Command line over the engine; ``serve`` answers the same over HTTP."""

from __future__ import annotations

import argparse
import contextlib
import gzip
import io
import json
import sys
import uuid
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, quote, unquote, urlparse

from pyspark.sql import SparkSession

from .api import Engine
from .plans.sqlgate import Refused, json_rows
from .streaming.ingest import Conflict

MOST_BYTES = 64 << 20


def render(rows: list[dict], width: int = 40) -> str:
    """Rows as a table of fixed width."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    cells = [[str(r.get(n, ""))[:width] for n in names] for r in rows]
    wide = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    line = lambda xs: "  ".join(x.ljust(w) for x, w in zip(xs, wide, strict=True)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in wide]), *map(line, cells)])


def render_waterfall(rows: list[dict], width: int = 50) -> str:
    """A trace's spans as bars under each other."""
    out = []
    for r in rows:
        at = int(r["offset_pct"] / 100 * width)
        bar = " " * at + "#" * max(1, int(r["width_pct"] / 100 * width))
        out.append(f"{'  ' * r['depth']}{r['action']}".ljust(36)[:36] + f"|{bar[: width + 1].ljust(width + 1)}| {r['duration_ms']:.1f} ms {r['status']}")
    return "\n".join(out)


def demo_records() -> list[dict]:
    """Two sessions that share an indicator and a technique, a web request and an AI call."""
    base = {"action": "exec", "raw": "powershell -enc payload http://c2.example.net/a 203.0.113.9:443", "technique_ids": ["T1059"], "indicators": {"ip": ["203.0.113.9"]}}
    return [
        base | {"ts": "2024-01-01T00:00:00Z", "host": "alpha", "session_id": "s1", "event_id": "d1"}, base | {"ts": "2024-01-01T00:01:00Z", "host": "beta", "session_id": "s2", "event_id": "d2"},
        {"ts": "2024-01-01T00:02:00Z", "host": "alpha", "action": "http.request", "raw": "GET /", "event_id": "d3", "attributes": {"trace_id": "t1", "span_id": "p1", "duration_ms": "60", "status": "ok"}},
        {"ts": "2024-01-01T00:02:00.020Z", "host": "alpha", "action": "chat", "raw": "", "event_id": "d4", "attributes": {"trace_id": "t1", "span_id": "p2", "parent_span_id": "p1", "duration_ms": "35", "gen_ai.request.model": "demo", "gen_ai.usage.input_tokens": "210", "gen_ai.usage.output_tokens": "45"}},
    ]


def demo_otlp() -> tuple[str, str]:
    """A trace of a request with a failing call to a model, and a log of it, as OpenTelemetry payloads."""
    attr = lambda k, v: {"key": k, "value": {"stringValue": v} if isinstance(v, str) else {"intValue": str(v)}}
    trace, start = "5b8aa5a2d2c872e8321cf37308d69df2", 1_704_067_200_000_000_000
    resource = {"attributes": [attr("service.name", "shop"), attr("host.name", "gamma")]}
    span = lambda i, parent, name, at, ms, more, code=0: {"traceId": trace, "spanId": f"{i:016x}", "parentSpanId": parent and f"{parent:016x}", "name": name, "startTimeUnixNano": str(start + at * 1_000_000), "endTimeUnixNano": str(start + (at + ms) * 1_000_000), "attributes": more, "status": {"code": code}}
    spans = [span(1, 0, "GET /order", 0, 90, [attr("http.route", "/order")]), span(2, 1, "chat", 10, 60, [attr("gen_ai.system", "demo"), attr("gen_ai.request.model", "demo-1"), attr("gen_ai.usage.input_tokens", 210), attr("gen_ai.usage.output_tokens", 45)], 2)]
    log = {"timeUnixNano": str(start + 70_000_000), "severityText": "ERROR", "body": {"stringValue": "the model did not answer"}, "attributes": [], "traceId": trace, "spanId": f"{2:016x}"}
    traces = {"resourceSpans": [{"resource": resource, "scopeSpans": [{"scope": {"name": "demo"}, "spans": spans}]}]}
    logs = {"resourceLogs": [{"resource": resource, "scopeLogs": [{"logRecords": [log]}]}]}
    return json.dumps(traces), json.dumps(logs)


def read_body(body: str) -> list[dict]:
    """Records of a request's body: a JSON array, one object, or JSON lines; an error names its line."""
    with contextlib.suppress(ValueError):
        data = json.loads(body)
        rows = data if isinstance(data, list) else [data]
        if all(isinstance(r, dict) for r in rows):
            return rows
        raise TypeError("records must be objects")
    out = []
    for number, line in enumerate(body.splitlines(), 1):
        if line.strip():
            try:
                out.append(json.loads(line))
            except ValueError as e:
                raise ValueError(f"line {number}: {e}") from None
            if not isinstance(out[-1], dict):
                raise ValueError(f"line {number}: a record must be an object")
    return out


def _route(path: str) -> list[str]:
    """Parts of a path below ``/``, ``/api`` or, for traces and logs, ``/v1`` or ``/api/v1``."""
    parts = [p for p in path.split("/") if p]
    parts = parts[1:] if parts[:1] == ["api"] else parts
    if parts[:1] == ["v1"]:
        if parts[1:2] not in (["traces"], ["logs"]):
            raise KeyError(path)
        parts = parts[1:]
    return parts


def answer(engine: Engine, path: str, args: dict):
    """A read route's JSON value, or KeyError for an unknown one."""
    limit = int(args.get("limit", 100))
    parts = _route(path) or ["status"]
    whole = {
        ("status",): engine.status, ("ledger", "verify"): engine.verify, ("verify-ledger",): engine.verify, ("services",): lambda: json_rows(engine.services()),
        ("traces",): lambda: json_rows(engine.trace_summaries(args.get("service"), args.get("status"), limit)), ("groups",): lambda: json_rows(engine.groups()), ("sources",): lambda: json_rows(engine.tables()["source_checkpoints"]()),
        ("logs",): lambda: json_rows(engine.logs(limit=limit, **{k: args[k] for k in ("service", "trace_id", "span_id", "severity") if k in args})),
        ("ai", "calls"): lambda: json_rows(engine.ai_calls(args.get("service"), args.get("model"), limit)), ("search",): lambda: json_rows(engine.search(args["q"], args.get("filter"), limit=limit, bm25=args.get("mode") == "bm25")),
        ("query",): lambda: json_rows(engine.query(args["sql"], limit)), ("links",): lambda: json_rows(engine.links().limit(limit)), ("queue",): lambda: json_rows(engine.queue().orderBy("position").limit(limit)),
        ("reconstruct",): lambda: dict(zip(("edges", "roles"), map(json_rows, engine.reconstruct(args["seed"])), strict=True)),
    }
    one = {"traces": lambda i: json_rows(engine.trace_tree(i)), "spans": lambda i: json_rows(engine.span(i)), "groups": lambda i: {k: json_rows(v) for k, v in engine.group_view(i).items()}}
    if tuple(parts) in whole:
        return whole[tuple(parts)]()
    if len(parts) == 2 and parts[0] in one:
        return one[parts[0]](unquote(parts[1]))
    raise KeyError(path)


def change(engine: Engine, path: str, body: str):
    """A write route's JSON value, or KeyError for an unknown one."""
    parts = _route(path)
    batch = uuid.uuid4().hex
    if parts in (["traces"], ["logs"]):
        return {"accepted": engine.ingest_otlp(body, batch, parts[0])}
    if parts == ["ingest"]:
        return {"accepted": engine.ingest_records(read_body(body), batch)}
    if parts == ["seal"]:
        return {"sealed": engine.seal(), "indexed": engine.index()}
    if parts == ["query"]:
        given = json.loads(body)
        return json_rows(engine.query(given["sql"], int(given.get("limit", 1000))))
    if parts[:1] == ["groups"] and parts[2:] == ["review"]:
        given = json.loads(body)
        return json_rows(engine.review(given["trace_id"], unquote(parts[1]), given["state"]))
    if parts in (["model", "train"], ["model"]):
        rows = engine.spark.createDataFrame([(r["a"], r["b"], int(r["label"])) for r in json.loads(body)], "a string, b string, label int")
        return {"scored": engine.train(rows).count()}
    if parts == ["attribute"]:
        return json_rows(engine.attribute(_training(engine, json.loads(body))))
    if parts == ["demo"]:
        return {"accepted": engine.ingest_records(demo_records(), "demo")}
    if parts == ["demo", "otlp"]:
        traces, logs = demo_otlp()
        return {"accepted": engine.ingest_otlp(traces, "demo-traces") + engine.ingest_otlp(logs, "demo-logs", "logs")}
    raise KeyError(path)


def _training(engine: Engine, rows: list[dict]):
    return engine.spark.createDataFrame([(r["actor"], list(r["tokens"]), list(r.get("techniques", []))) for r in rows], "actor string, tokens array<string>, techniques array<string>")


def demo(engine: Engine) -> str:
    """The whole path over the demo's records: ingest, features, candidates and scores, groups, attribution, and what came of it."""
    change(engine, "/demo", "")
    change(engine, "/demo/otlp", "")
    engine.seal()
    engine.index()
    links, groups = json_rows(engine.links()), json_rows(engine.groups())
    known = [{"actor": "alpha", "tokens": ["powershell", "payload", "exec"], "techniques": ["T1059"]}, {"actor": "beta", "tokens": ["ssh", "scan"], "techniques": ["T1021"]}] * 3
    outcomes = json_rows(engine.attribute(_training(engine, known))) if groups else []
    counts = {"events": engine.events().count(), "traces": engine.traces().count(), "links": len(links), "groups": len({g["group_id"] for g in groups}), "unresolved": sum(o["status"] == "unresolved" for o in outcomes), "verified": engine.verify()["ok"]}
    return "\n\n".join([render(json_rows(engine.trace_summaries())), render(links), render(groups), render(outcomes), json.dumps(counts)])


#: A page over the read routes.
PAGE = """<!doctype html><meta charset=utf-8><title>tracelode</title><style>body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 6px;text-align:left}</style>
<h1>tracelode</h1><p><input id=q placeholder="SELECT ... FROM events"><button onclick="show('query?sql='+encodeURIComponent(q.value))">query</button>
<span id=nav></span></p><div id=out></div><script>
for (const r of ['status','services','traces','logs','ai/calls','groups','links','queue','sources','ledger/verify']) nav.innerHTML += ` <a href="#" onclick="show('${r}')">${r}</a>`;
const cell = v => { const d = document.createElement('td'); d.textContent = typeof v == 'object' ? JSON.stringify(v) : v; return d; };
async function show(r) { const rows = await (await fetch('/api/' + r)).json(); out.textContent = '';
 if (!Array.isArray(rows) || !rows.length) { out.textContent = JSON.stringify(rows, null, 1); return; }
 const t = document.createElement('table'), names = Object.keys(rows[0]), head = t.insertRow(); names.forEach(n => head.append(cell(n)));
 rows.forEach(x => { const tr = t.insertRow(); names.forEach(n => tr.append(cell(x[n]))); }); out.append(t); }
show('status');</script>"""


class Handler(BaseHTTPRequestHandler):
    engine: Engine

    def _send(self, code: int, value) -> None:
        data = json.dumps(value, default=str).encode()
        self.send_response(code)
        self.send_header("Content-Type", "application/json")
        self.send_header("Content-Length", str(len(data)))
        self.end_headers()
        self.wfile.write(data)

    def _run(self, work) -> None:
        try:
            self._send(200, work())
        except (KeyError, FileNotFoundError) as e:
            self._send(404, {"error": str(e)})
        except Conflict as e:
            self._send(409, {"error": str(e)})
        except (Refused, ValueError) as e:
            self._send(400, {"error": str(e)})
        except Exception as e:  # noqa: BLE001 - a server answers
            self._send(500, {"error": str(e)[:500]})

    def do_GET(self) -> None:  # noqa: N802
        url = urlparse(self.path)
        if url.path == "/":
            self.send_response(200)
            self.send_header("Content-Type", "text/html; charset=utf-8")
            self.end_headers()
            self.wfile.write(PAGE.encode())
            return
        self._run(lambda: answer(self.engine, url.path, {k: v[-1] for k, v in parse_qs(url.query).items()}))

    def do_POST(self) -> None:  # noqa: N802
        size = int(self.headers.get("Content-Length") or 0)
        if size > MOST_BYTES:
            self._send(413, {"error": "the body is too large"})
            return
        body = self.rfile.read(size)
        if self.headers.get("Content-Encoding") == "gzip":
            with gzip.GzipFile(fileobj=io.BytesIO(body)) as f:
                body = f.read(MOST_BYTES + 1)
            if len(body) > MOST_BYTES:
                self._send(413, {"error": "the body is too large"})
                return
        self._run(lambda: change(self.engine, urlparse(self.path).path, body.decode()))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracelode")
    p.add_argument("--data", default="data")
    sub = p.add_subparsers(dest="command", required=True)
    for name, options in {
        "serve": ["--port"], "ingest": ["path", "--kind", "--batch"], "seal": [], "index": [], "search": ["query", "--filter", "--limit", "--mode"], "verify": [], "verify-ledger": [], "demo": [], "demo-ingest": [],
        "query": ["sql", "--limit"], "groups": [], "traces": ["--id", "--service", "--status", "--limit"], "spans": ["id"], "logs": ["--service", "--severity", "--limit"], "services": [], "ai": ["--service", "--model", "--limit"],
        "queue": ["--limit"], "reconstruct": ["seed"], "attribute": ["path"], "export-ledger": ["path"],
    }.items():
        s = sub.add_parser(name)
        for o in options:
            s.add_argument(o)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("tracelode").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    engine = Engine(spark, args.data)
    given = {k: v for k, v in vars(args).items() if v is not None and k not in ("command", "data")}
    c = args.command
    if c == "serve":
        Handler.engine = engine
        HTTPServer(("127.0.0.1", int(args.port or 8080)), Handler).serve_forever()
    elif c in ("ingest",):
        print(json.dumps({"accepted": engine.ingest_path(args.path, args.batch or uuid.uuid4().hex, kind=args.kind or "jsonl")}))
    elif c == "demo-ingest":
        print(json.dumps(change(engine, "/demo", "")))
    elif c == "demo":
        print(demo(engine))
    elif c == "attribute":
        with open(args.path) as f:
            print(render(change(engine, "/attribute", f.read())))
    elif c == "export-ledger":
        print(json.dumps({"head": engine.export_ledger(args.path)}))
    elif c in ("seal", "index"):
        print(json.dumps(getattr(engine, c)()))
    elif c in ("verify", "verify-ledger"):
        report = engine.verify()
        print(json.dumps(report))
        return int(not report["ok"])
    elif c == "traces" and args.id:
        print(render_waterfall(json_rows(engine.trace_tree(args.id))))
    else:
        path = {"spans": f"spans/{quote(given.get('id', ''), safe='')}", "ai": "ai/calls"}.get(c, c)
        named = {"q" if k == "query" else k: v for k, v in given.items()}
        got = answer(engine, path, named)
        print(render(got) if isinstance(got, list) else json.dumps(got))
    return 0


if __name__ == "__main__":
    sys.exit(main())
