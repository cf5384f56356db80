"""The tools over the Model Context Protocol: JSON-RPC 2.0, one message a line."""

from __future__ import annotations

import json
from collections.abc import Iterable
from typing import TextIO

from quarrylight.api import TEXTS, TOOLS, CodeIndex

PROTOCOL = "2024-11-05"
#: Codes of JSON-RPC. Fixed values.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND, INVALID_PARAMS = -32700, -32600, -32601, -32602
VERSION = "2.0"


def schema_of(name: str) -> dict:
    """A tool as clients list it."""
    description, arguments, required = TOOLS[name]
    properties = {a: {"type": t, **({"items": {"type": "string"}} if t == TEXTS else {}), "description": what} for a, (t, what) in arguments.items()}
    if name == "update_summary":
        properties["type"]["enum"] = ["file", "function"]
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, **({"required": required} if required else {})}}


def call(tools: CodeIndex, name: str, arguments: dict) -> dict:
    """The result of a tool call; whatever fails is an error of the tool."""
    if name not in TOOLS:
        return {"content": [{"type": "text", "text": f"Unknown tool: {name}"}], "isError": True}
    try:
        text, failed = tools.call(name, **arguments), False
    except Exception as problem:  # noqa: BLE001 - a failing write is told to the client
        text, failed = f"Error executing {name}: {problem}", True
    return {"content": [{"type": "text", "text": text}], "isError": failed}


def respond(tools: CodeIndex, message: dict) -> dict | None:
    """The answer to one message; None for notifications."""

    def answer(**body) -> dict:
        return {"jsonrpc": VERSION, "id": message.get("id"), **body}

    if not isinstance(message, dict) or not isinstance(message.get("method"), str):
        return {"jsonrpc": VERSION, "id": None, "error": {"code": INVALID_REQUEST, "message": "not a request"}}
    if "id" not in message:
        return None
    method, params = message["method"], message.get("params") or {}
    if method == "initialize":
        wanted = params.get("protocolVersion")
        return answer(result={"protocolVersion": wanted if isinstance(wanted, str) else PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quarrylight", "version": "1.0"}, "instructions": "Read and update the index of this repository's code."})
    if method == "ping":
        return answer(result={})
    if method == "tools/list":
        return answer(result={"tools": [schema_of(n) for n in TOOLS]})
    if method == "tools/call":
        name, arguments = params.get("name"), params.get("arguments") or {}
        if not isinstance(name, str) or not isinstance(arguments, dict):
            return answer(error={"code": INVALID_PARAMS, "message": "name and arguments are required"})
        return answer(result=call(tools, name, arguments))
    return answer(error={"code": METHOD_NOT_FOUND, "message": f"unknown method {method}"})


def serve(tools: CodeIndex, lines: Iterable[str], out: TextIO) -> None:
    """Answers every message until the input ends."""
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError as problem:
            answers = {"jsonrpc": VERSION, "id": None, "error": {"code": PARSE_ERROR, "message": str(problem)}}
        else:
            answers = [a for m in message if (a := respond(tools, m))] if isinstance(message, list) else respond(tools, message)
        if answers:
            print(json.dumps(answers), file=out, flush=True)
