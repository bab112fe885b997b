"""The line protocol: a request a line, one JSON text as the answer."""

from __future__ import annotations

import json
import os
import socketserver
import threading
import time

from .index import postings, statistics
from .search import Engine, answer, request_search, request_search_all

# The modes of a request and the kinds they stand for.
MODES = {"edit": "edit", "gotofile": "files", "gotodir": "folders"}


class RequestError(ValueError):
    pass


def _fields(text: str, required: dict, optional: dict | None = None) -> dict:
    """The fields of a JSON request; kinds: of each, by name."""
    try:
        got = json.loads(text)
    except ValueError as problem:
        raise RequestError(str(problem)) from None
    if not isinstance(got, dict):
        raise RequestError("an object is expected")
    for name, kind in (required | (optional or {})).items():
        if name in required and name not in got:
            raise RequestError(f"missing field {name}")
        if got.get(name) is not None and not isinstance(got[name], kind):
            raise RequestError(f"{name} must be {kind.__name__}")
    return got


def _search(engine: Engine, text: str) -> str:
    asked = _fields(text, {"query": str}, {"bookmark_path": str, "mode": str, "extension": str})
    began = time.monotonic()
    rows = request_search(engine.catalog, asked["query"], asked.get("bookmark_path") or "", asked.get("extension"), MODES.get(asked.get("mode"), "all"), engine.most)
    return _answer(engine, rows, began)


def _search_all(engine: Engine, text: str) -> str:
    asked = _fields(text, {"query": str}, {"bookmark_paths": list, "extension": str})
    began = time.monotonic()
    rows = request_search_all(engine.catalog, asked["query"], engine.roots, asked.get("bookmark_paths") or None, asked.get("extension"), engine.most)
    return _answer(engine, rows, began)


def _answer(engine: Engine, rows, began: float) -> str:
    kept = rows.persist()  # at most `most` rows
    kept.count()
    took = int((time.monotonic() - began) * 1000)
    out = answer(kept, engine.file_count(), took).first().json
    kept.unpersist()
    return out


def _add_bookmark(engine: Engine, text: str) -> str:
    asked = _fields(text, {"name": str, "path": str}, {"is_network": bool})
    engine.add_bookmark(asked["name"], asked["path"], is_network=bool(asked.get("is_network")))
    return json.dumps({"status": "ok", "indexed": engine.file_count()})


def _rescan(engine: Engine, path: str) -> str:
    return json.dumps({"status": "ok", "indexed": engine.rescan_path(path.strip())})


def _stats(engine: Engine, _: str) -> str:
    if engine.counted is None or engine.counted[0] is not engine.catalog:  # once for each state of the catalog
        numbered = engine.catalog.selectExpr("path", "xxhash64(path) as id")
        engine.counted = (engine.catalog, statistics(numbered, postings(numbered), len(engine.roots)).first())
    row = engine.counted[1]
    return json.dumps({"files": row.files, "trigrams": row.trigrams, "bookmarks": len(engine.roots)})


def _ping(engine: Engine, _: str) -> str:
    return json.dumps({"status": "pong"})


# The commands, with whether something follows them.
COMMANDS = {"SEARCH": (_search, True), "SEARCH_ALL": (_search_all, True), "ADD_BOOKMARK": (_add_bookmark, True), "RESCAN": (_rescan, True), "STATS": (_stats, False), "PING": (_ping, False)}


def answer_line(engine: Engine, line: str) -> str:
    """The answer to a request; what is wrong with it comes back as {"error": ...}."""
    command, gap, rest = line.rstrip("\r\n").partition(" ")
    run, more = COMMANDS.get(command, (None, False))
    if run is None or bool(gap) != more:
        return json.dumps({"error": "unknown command"})
    try:
        return run(engine, rest)
    except RequestError as problem:
        return json.dumps({"error": str(problem)})


def serve(engine: Engine, socket_path: str) -> socketserver.ThreadingUnixStreamServer:
    """Answer requests at a socket of this machine until shutdown() is called. An old socket file is replaced."""

    class Client(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            for line in self.rfile:
                self.wfile.write(answer_line(engine, line.decode("utf-8", "replace")).encode() + b"\n")

    if os.path.exists(socket_path):
        os.remove(socket_path)
    server = socketserver.ThreadingUnixStreamServer(socket_path, Client)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server
