"""Messages of small sessions, written by hand."""

from __future__ import annotations

import json

from threadloom.schema import MESSAGES


def message(role, **fields):
    return {"role": role, **fields}


def user(text):
    return message("user", content_text=text)


def block(kind, **fields):
    return {"type": kind, "text": None, "thinking": None, "id": None, "name": None, "arguments_json": None, **fields}


def said(*blocks):
    return message("assistant", blocks=[b if isinstance(b, dict) else block("text", text=b) for b in blocks])


def call(name, arguments, call_id):
    return said(block("toolCall", id=call_id, name=name, arguments_json=json.dumps(arguments)))


def result(name, text, call_id=None, error=False, **fields):
    return message("toolResult", tool_name=name, blocks=[block("text", text=text)], tool_call_id=call_id, is_error=error, **fields)


def run(command, output, code=0, cancelled=False):
    return message("bashExecution", command=command, output=output, exit_code=code, cancelled=cancelled)


def used(name, arguments, text, call_id, error=False):
    return [call(name, arguments, call_id), result(name, text, call_id, error)]


def big(filler, lines=400):
    return "\n".join(filler * 40 for _ in range(lines))


def frame(spark, sessions: dict[str, list[dict]]):
    rows = [{"session_id": s, "message_index": i, **m} for s, all_ in sessions.items() for i, m in enumerate(all_)]
    names = [f.split(" ")[0] for f in MESSAGES.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], MESSAGES)
