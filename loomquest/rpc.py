"""The tools over JSON-RPC 2.0, one message a line: python -m loomquest.rpc serves on standard input and output.

web_search answers at once; start_campaign starts a process of its own, which outlives the call, and read_campaign tells how far it is. What the engine
prints goes to standard error, so that the channel stays clean."""

from __future__ import annotations

import contextlib
import json
import os
import subprocess
import sys

from loomquest.functions import goals
from loomquest.plans import lock, report
from loomquest.sources import files

PROTOCOL, NO_METHOD, BAD_PARAMS = "2024-11-05", -32601, -32602


def _tool(name: str, text: str, required: list[str], **fields: str) -> dict:
    return {"name": name, "description": text, "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in fields.items()}, "required": required}}


TOOLS = [
    _tool("web_search", "Search the web now with the keyless backends.", ["query"], query="string", backends="string", per_backend="number"),
    _tool(
        "start_campaign", "Start a campaign in the background; read it with read_campaign.", ["question"],
        question="string", scope="string", queries="number", backends="string", deep="boolean", discover="boolean", synth="boolean", extract="boolean",
    ),
    _tool("read_campaign", "The result of a campaign, or how far it is.", ["slug"], slug="string", section="string"),
]


def folder() -> str:
    return files.output_dir(os.path.abspath("out"))


def engine():
    from pyspark.sql import SparkSession

    from loomquest.models.clients import client, setting
    from loomquest.plans.engine import Engine

    say = lambda text: print(text, file=sys.stderr, flush=True)
    return Engine(SparkSession.builder.appName("loomquest").getOrCreate(), folder(), client=client(), model=setting("EXTRACT_MODEL") or None, cache_path=f"{folder()}/cache", say=say)


def started(args: dict, launch=subprocess.Popen) -> str:
    """Starts a campaign apart from this process, unless one runs; old markers go first."""
    from loomquest import tools

    tools.wanted(args, "question")
    where, plan = folder(), tools.plan(args, folder())
    if lock.holder(where):
        return plan
    p = report.paths(where, goals.slug(args["question"]))
    p["done"].parent.mkdir(parents=True, exist_ok=True)
    for k in ("done", "report"):
        p[k].unlink(missing_ok=True)
    with p["trace"].open("w", encoding="utf-8") as log:
        launch([sys.executable, "-m", "loomquest.rpc", "--campaign", json.dumps(args)], stdout=log, stderr=log, stdin=subprocess.DEVNULL, start_new_session=True)
    return f'{plan}\nStarted in the background. Call read_campaign(slug="{goals.slug(args["question"])}") for the result.'


def called(name: str, args: dict, make=engine, launch=subprocess.Popen) -> str:
    from loomquest import tools

    if name == "web_search":
        return tools.web_search(make(), args)
    return started(args, launch) if name == "start_campaign" else tools.read_campaign(folder(), args)


def answer(message: dict, call=called) -> dict | None:
    """The reply to one message; None for notifications."""
    method, params, key = message.get("method"), message.get("params") or {}, message.get("id")
    if key is None:
        return None
    reply = lambda **what: {"jsonrpc": "2.0", "id": key, **what}
    if method == "initialize":
        return reply(result={"protocolVersion": params.get("protocolVersion") or PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "loomquest", "version": "1"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": TOOLS})
    if method != "tools/call":
        return reply(error={"code": NO_METHOD, "message": f"no method {method}"})
    if params.get("name") not in {t["name"] for t in TOOLS}:
        return reply(error={"code": BAD_PARAMS, "message": f"no tool {params.get('name')}"})
    try:
        with contextlib.redirect_stdout(sys.stderr):
            text, failed = call(params["name"], params.get("arguments") or {}), False
    except Exception as e:  # a tool's failure is an answer, not the end of the server
        text, failed = f"{type(e).__name__}: {e}", True
    return reply(result={"content": [{"type": "text", "text": text}], "isError": failed})


def serve(lines, write, call=called) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            continue
        if isinstance(message, dict) and (out := answer(message, call)) is not None:
            write(json.dumps(out, ensure_ascii=False) + "\n")


def main(argv: list[str]) -> None:
    if argv[:1] == ["--campaign"]:
        from loomquest import tools

        tools.run_campaign(engine(), json.loads(argv[1]))
        return
    serve(sys.stdin, lambda s: (sys.stdout.write(s), sys.stdout.flush()))


if __name__ == "__main__":
    main(sys.argv[1:])
