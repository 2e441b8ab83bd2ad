"""What is sent to chat services and how their answers are read: payloads, schemas, checks of items, skipped rows."""

from __future__ import annotations

import json

from cloakframe.spans.measure import json_object

# ---- Fixed values: answers that are taken.
DECISIONS = ("agree", "disagree", "uncertain")
TASKS = {"verifier": {"decision": DECISIONS}, "classifier": {"hate": (True, False)}, "restatement": {}}


class BadAnswer(ValueError):
    """An answer that does not say what was asked."""


def payload(model: str, system: str, rows: list[dict], schema: dict, name: str = "submit_items", temperature: float = 0.0) -> dict:
    """A chat-completion request whose answer must be a call of one tool with that schema."""
    return {
        "model": model,
        "temperature": temperature,
        "messages": [{"role": "system", "content": system}, {"role": "user", "content": user_message(rows)}],
        "tools": [{"type": "function", "function": {"name": name, "parameters": schema}}],
        "tool_choice": {"type": "function", "function": {"name": name}},
    }


def user_message(rows: list[dict]) -> str:
    return json.dumps({"items": rows}, ensure_ascii=False, sort_keys=True)


def items_schema(fields: dict[str, dict]) -> dict:
    """An object with a list of items, each with an id and these fields, all needed."""
    item = {"id": {"type": "string"}, **fields}
    return {"type": "object", "properties": {"items": {"type": "array", "items": {"type": "object", "properties": item, "required": [*item], "additionalProperties": False}}}, "required": ["items"], "additionalProperties": False}


def verifier_schema(reasons: tuple[str, ...]) -> dict:
    return items_schema({"decision": {"type": "string", "enum": [*DECISIONS]}, "suggested_label": {"type": ["boolean", "null"]}, "reason": {"type": "string", "enum": sorted(reasons)}})


def classifier_schema(reasons: tuple[str, ...]) -> dict:
    return items_schema({"hate": {"type": "boolean"}, "reason": {"type": "string", "enum": sorted(reasons)}})


def answer(response: dict) -> dict:
    """The JSON object of a chat answer: the arguments of its first tool call, else of its function call, else its text."""
    try:
        message = response["choices"][0]["message"]
    except (KeyError, IndexError, TypeError) as e:
        raise BadAnswer("no chat message") from e
    if not isinstance(message, dict):
        raise BadAnswer("the message is no object")
    calls = [c.get("function") for c in message.get("tool_calls") or [] if isinstance(c, dict)] + [message.get("function_call")]
    said = next((c.get("arguments") for c in calls if isinstance(c, dict)), message.get("content"))
    if isinstance(said, dict):
        return said
    got = json_object(said) if isinstance(said, str) else {}
    if not got:
        raise BadAnswer("no JSON object")
    return got


def items(said: dict, ids: list[str], positional: bool = False) -> list[tuple[str, dict]]:
    """(id, item) of an answer, one for each id asked about. positional: an unknown or repeated id counts as the one in its place."""
    got = said.get("items")
    if not isinstance(got, list):
        raise BadAnswer("no list of items")
    if len(got) != len(set(ids)):
        raise BadAnswer("another number of items")
    out, seen = [], set()
    for k, item in enumerate(got):
        if not isinstance(item, dict):
            raise BadAnswer("an item is no object")
        name = str(item.get("id") or "")
        if positional and (name not in ids or name in seen):
            name = ids[k]
        if name not in ids or name in seen:
            raise BadAnswer("an id that was not asked about")
        seen.add(name)
        out.append((name, item))
    return out


def verifier_items(said: dict, ids: list[str], reasons: tuple[str, ...]) -> list[dict]:
    out = []
    for name, item in items(said, ids):
        decision, label, reason = item.get("decision"), item.get("suggested_label"), item.get("reason")
        if decision not in DECISIONS:
            raise BadAnswer("no such decision")
        if label is not None and not isinstance(label, bool):
            raise BadAnswer("the label is no boolean")
        if reason not in reasons:
            raise BadAnswer("no such reason")
        out.append({"id": name, "decision": decision, "suggested_label": label, "reason": reason, "parse_status": "ok"})
    return out


def classifier_items(said: dict, ids: list[str], reasons: tuple[str, ...], positional: bool = False) -> list[dict]:
    out = []
    for name, item in items(said, ids, positional):
        if not isinstance(item.get("hate"), bool):
            raise BadAnswer("hate is no boolean")
        if item.get("reason") not in reasons:
            raise BadAnswer("no such reason")
        out.append({"id": name, "hate": item["hate"], "reason": item["reason"], "parse_status": "ok"})
    return out


def restatements(said: dict, ids: list[str]) -> list[dict]:
    """Restated texts, trimmed and with single spaces; an empty one is a bad answer."""
    out = []
    for name, item in items(said, ids):
        text = " ".join(str(item.get("restatement") or "").split())
        if not text:
            raise BadAnswer("an empty restatement")
        out.append({"id": name, "restatement": text, "parse_status": "ok"})
    return out


def skipped(ids: list[str], why: str) -> list[dict]:
    """Rows that have no answer, with the reason (80 characters at most)."""
    return [{"id": i, "parse_status": "skipped", "reason": why[:80]} for i in ids]


def ask(rows: list[dict], call, read, batch: int = 10) -> list[dict]:
    """Answers of all rows, in batches; a batch whose answer is bad is asked row by row, and a row that still fails is skipped.

    call: a function from rows to a response; read: one from (answer, ids) to items.
    """
    out = []
    for k in range(0, len(rows), batch):
        some = rows[k : k + batch]
        for part in (some, *([r] for r in some)):
            ids = [r["id"] for r in part]
            try:
                got = read(answer(call(part)), ids)
            except (BadAnswer, OSError) as e:
                if len(part) == 1 and (len(some) == 1 or part is not some):
                    out += skipped(ids, str(e))
                    if part is some:
                        break
                continue
            out += got
            if part is some:
                break
    return out


def run_record(answers: list[dict], seconds: float) -> dict:
    """Rows, parsed rows, share of them, seconds a row."""
    n, ok = len(answers), sum(a["parse_status"] == "ok" for a in answers)
    return {"row_count": n, "parse_count": ok, "parse_success_rate": round(ok / n, 4) if n else 0.0, "seconds_per_row": round(seconds / n, 4) if n else 0.0}


def hate_index(names: dict[int, str]) -> int:
    """Which output of a classifier means hate: by its name, else the last one."""
    low = {k: v.lower() for k, v in names.items()}
    sure = [k for k, v in sorted(low.items()) if ("hate" in v or "hateful" in v or "offensive" in v) and not v.startswith(("non", "not", "no_", "no-"))]
    return sure[0] if sure else max(low)
