"""The engine as a service: methods first, and a small HTTP front end over them."""

from __future__ import annotations

import json
import time
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from threading import Lock
from urllib.parse import parse_qs, urlparse

from sparkdex.plans import ast
from sparkdex.plans.engine import DEFAULT_LIMIT, Engine
from sparkdex.plans.parser import parse, parse_script


#: The page of GET /: a box for statements, results as a table of at most 150 rows, pictures and sound shown.
PAGE = """<!doctype html><meta charset="utf-8"><title>sparkdex</title>
<style>body{font:15px sans-serif;margin:2em}textarea{width:100%;height:7em}td,th{border:1px solid #bbb;padding:.2em .5em}table{border-collapse:collapse;margin:1em 0}img{max-height:6em}</style>
<h1>sparkdex</h1><p>Tables: <span id="tables"></span></p>
<textarea id="q">SELECT * FROM t LIMIT 20</textarea><p><button id="go">Run</button> <input type="file" id="f"> <input id="name" placeholder="table"> <button id="up">Load CSV</button></p><div id="out"></div>
<script>
const out = document.getElementById("out"), box = document.getElementById("q"), file = document.getElementById("f");
const cell = v => { const s = v === null ? "" : String(v), ext = s.split(".").pop().toLowerCase();
  if (["png", "jpg", "jpeg", "gif", "bmp"].includes(ext)) return Object.assign(new Image(), {src: s, title: s});
  if (["wav", "mp3", "ogg"].includes(ext)) return Object.assign(document.createElement("audio"), {src: s, controls: true});
  return document.createTextNode(s); };
const show = r => { out.textContent = ""; if (r.detail) { out.textContent = r.detail; return; }
  for (const x of r.results || [r]) { const t = out.appendChild(document.createElement("table"));
    if (!x.columns) { t.insertRow().insertCell().textContent = JSON.stringify(x); continue; }
    const h = t.insertRow(); x.columns.forEach(c => h.appendChild(document.createElement("th")).textContent = c);
    x.rows.slice(0, 150).forEach(row => { const tr = t.insertRow(); row.forEach(v => tr.insertCell().appendChild(cell(v))); }); }
  list(); };
const post = (u, b) => fetch(u, {method: "POST", body: b}).then(r => r.json()).then(show);
const list = () => fetch("/api/tables").then(r => r.json()).then(t => document.getElementById("tables").textContent = t.join(", "));
document.getElementById("go").onclick = () => box.value.includes("<->") && file.files[0]
  ? post("/api/sql_mm_query?" + new URLSearchParams({query: box.value, name: file.files[0].name}), file.files[0]) : post("/api/sql", JSON.stringify({query: box.value}));
document.getElementById("up").onclick = () => post("/api/upload?" + new URLSearchParams({table: document.getElementById("name").value, name: file.files[0].name}), file.files[0]);
list();
</script>"""


class Service:
    """What the endpoints do, with plain values in and out."""

    def __init__(self, engine: Engine):
        self.engine, self.lock = engine, Lock()

    def run_sql(self, query: str) -> dict:
        """Run a script. Similarity by path is refused: files come by sql_with_file."""
        began = time.time()
        statements = parse_script(query)
        if any(isinstance(s, ast.Select) and isinstance(s.where, ast.Similar) for s in statements):
            raise ValueError("a similarity query needs its file")
        with self.lock:
            results = [self.engine.execute(s).payload() for s in statements]
        return {"results": results, "execution_time": time.time() - began}

    def sql_with_file(self, query: str, name: str, data: bytes) -> dict:
        """One similarity query whose quoted path stands for the uploaded file."""
        began = time.time()
        s = parse(query)
        if not isinstance(s, ast.Select) or not isinstance(s.where, ast.Similar):
            raise ValueError("not a similarity query")
        with self.lock:
            r = self.engine.similar_to_bytes(s.table, s.where.column, name, data, s.where.k, s.where.mode, s.limit or s.where.k or DEFAULT_LIMIT)
            names = r.columns if "*" in s.columns else ["score", *s.columns]
            r.frame, r.columns = r.frame.select(*names), names
            return {"results": [r.payload()], "execution_time": time.time() - began}

    def upload_csv(self, table: str, name: str, data: bytes, has_header: bool = True) -> dict:
        if not name.lower().endswith(".csv"):
            raise ValueError("only .csv files can be loaded")
        with self.lock:
            return {"ok": True, "inserted": self.engine.load_csv_bytes(table, data, has_header)}

    def tables(self) -> list[str]:
        return self.engine.catalog.tables()

    def schema(self, table: str) -> dict:
        e = self.engine.catalog.load(table)
        return {"table": table, "schema": e.columns, "indexes": [[i.key, i.kind] for i in e.indexes]}


def serve(service: Service, port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server over a service; the caller runs serve_forever().

    GET / is a page to try it; POST /api/sql {"query"}; POST /api/sql_mm_query?query=&name= and POST
    /api/upload?table=&name=&has_header= with the file as body; GET /api/tables and
    /api/tables/NAME/schema. Errors in a request give 400, others 500.
    """

    class Handler(BaseHTTPRequestHandler):
        def _send(self, code: int, body: object) -> None:
            data = json.dumps(body, default=str).encode()
            self.send_response(code)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def _answer(self, f) -> None:
            try:
                self._send(200, f())
            except (ValueError, KeyError) as e:
                self._send(400, {"detail": str(e)})
            except Exception as e:  # noqa: BLE001 - reported to the client
                self._send(500, {"detail": str(e)})

        def do_GET(self) -> None:  # noqa: N802
            parts = urlparse(self.path).path.strip("/").split("/")
            if parts == [""]:
                data = PAGE.encode()
                self.send_response(200)
                self.send_header("Content-Type", "text/html; charset=utf-8")
                self.send_header("Content-Length", str(len(data)))
                self.end_headers()
                self.wfile.write(data)
                return
            if parts == ["api", "tables"]:
                self._answer(service.tables)
            elif len(parts) == 4 and parts[:2] == ["api", "tables"] and parts[3] == "schema":
                self._answer(lambda: service.schema(parts[2]))
            else:
                self._send(404, {"detail": "not found"})

        def do_POST(self) -> None:  # noqa: N802
            url = urlparse(self.path)
            q = {k: v[0] for k, v in parse_qs(url.query).items()}
            body = self.rfile.read(int(self.headers.get("Content-Length", 0)))
            if url.path == "/api/sql":
                self._answer(lambda: service.run_sql(json.loads(body)["query"]))
            elif url.path == "/api/sql_mm_query":
                self._answer(lambda: service.sql_with_file(q["query"], q["name"], body))
            elif url.path == "/api/upload":
                self._answer(lambda: service.upload_csv(q["table"], q["name"], body, q.get("has_header", "true").lower() != "false"))
            else:
                self._send(404, {"detail": "not found"})

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
