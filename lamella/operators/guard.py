"""Answers of a model that must be JSON: extraction, repair, validation, and asking again (L6, TXT16, TXT17)."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

RETRIES = 7
_FENCED = re.compile(r"```(?:json)?\s*\n(.*?)\n```", re.S)


class Refused(Exception):
    """The model seems to refuse: two answers in a row weren't JSON."""


class Invalid(Exception):
    """The answers ran out; ``issues`` has what was wrong with the last."""

    def __init__(self, kind: str, issues: list[str]):
        super().__init__(f"{kind}: {'; '.join(issues)}")
        self.kind, self.issues = kind, issues


def extract(response: str) -> str:
    bare = _FENCED.sub(lambda m: m[1], response)
    spans = [(bare.find(a), bare.rfind(b)) for a, b in ("[]", "{}")]
    found = sorted((s, e) for s, e in spans if 0 <= s < e)
    return bare[found[0][0] : found[0][1] + 1] if found else bare.strip()


def repair(text: str) -> str:
    """A best effort: quotes and keys become JSON's, comments and trailing commas go, what is open is closed. The text itself if that doesn't help."""
    try:
        json.loads(text)
        return text
    except ValueError:
        pass
    out, closing, i, n = [], [], 0, len(text)
    quotes = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
    words = {"None": "null", "True": "true", "False": "false", "undefined": "null", "NaN": "null"}
    while i < n:
        c = text[i]
        if c in quotes:
            j, made = i + 1, []
            while j < n and not (text[j] == quotes[c] and re.match(r"\s*([,:}\]]|\Z)", text[j + 1 :])):
                if text[j] == "\\" and j + 1 < n:
                    made.append(text[j : j + 2] if text[j + 1] != "'" else "'")
                    j += 2
                    continue
                made.append({'"': '\\"', "\n": "\\n", "\t": "\\t", "\r": "\\r"}.get(text[j], text[j]))
                j += 1
            out.append('"' + "".join(made) + '"')
            i = j + 1
        elif text.startswith("//", i):
            i = text.find("\n", i) if "\n" in text[i:] else n
        elif text.startswith("/*", i):
            i = text.find("*/", i) + 2 if "*/" in text[i:] else n
        elif c in "{[":
            closing.append("}" if c == "{" else "]")
            out.append(c)
            i += 1
        elif c in "}]":
            while closing and closing[-1] != c:
                out.append(closing.pop())
            if closing:
                closing.pop()
                out.append(c)
            i += 1
        elif c.isalpha() or c in "_$":
            m = re.match(r"[\w$]+", text[i:])
            word = words.get(m[0], m[0])
            out.append(word if word in ("null", "true", "false") else json.dumps(word))
            i += len(m[0])
        else:
            out.append(c)
            i += 1
    fixed = "".join(out) + "".join(reversed(closing))
    fixed = re.sub(r",(\s*[}\]])", r"\1", fixed)
    fixed = re.sub(r'(["}\]\d]|true|false|null)(\s*\n\s*)(["{\[])', r"\1,\2\3", fixed)
    try:
        json.loads(fixed)
    except ValueError:
        return text
    return fixed


def ask_json(ask: Callable[[list[dict]], str], messages: list[dict], schema: Callable[[object], list[str]], parse: Callable[[object], object], retries: int = RETRIES):
    """The parsed answer. Each retry has the first messages, the last answer, and what was wrong with it. schema returns issues; parse raises ValueError (its args are issues)."""
    history, broken, last = list(messages), 0, Invalid("empty", ["no answer"])
    for _ in range(retries + 1):
        answer = ask(history)
        if not answer.strip():
            last = Invalid("empty", ["the answer was empty"])
            continue
        try:
            value = json.loads(repair(extract(answer)))
        except ValueError as e:
            broken += 1
            last = Invalid("syntax", [str(e)])
            if broken >= 2:
                raise Refused(answer[:200]) from e
        else:
            broken = 0
            issues = schema(value)
            if issues:
                last = Invalid("schema", issues)
            else:
                try:
                    return parse(value)
                except ValueError as e:
                    last = Invalid("content", list(map(str, e.args)))
        told = {"syntax": "The JSON has a syntax error.", "schema": "The JSON has the wrong structure.", "content": "The JSON has these issues."}[last.kind]
        history = [*messages, {"role": "assistant", "content": answer}, {"role": "user", "content": "\n".join([told, *(f"- {x}" for x in last.issues), "Write the complete JSON again, without any other text."])}]
    raise last
