"""Prompt templates (TXT19): names in {{ }}, {% if %}, {% elif %}, {% else %}, {% for %}; values are escaped, a block's line end goes with it, files are read from one folder only."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import escape
from pathlib import Path

_PIECE = re.compile(r"\{\{\s*(.*?)\s*\}\}|\{%\s*(.*?)\s*%\}\n?|\{#.*?#\}", re.S)
_NAME = re.compile(r"[A-Za-z_][\w.]*\Z")


def look_up(expression: str, values: dict):
    """A dotted name, a quoted string, a number, or ``not`` before one; an unknown name is None."""
    expression = expression.strip()
    if expression.startswith("not "):
        return not look_up(expression[4:], values)
    if len(expression) > 1 and expression[0] == expression[-1] and expression[0] in "'\"":
        return expression[1:-1]
    if re.fullmatch(r"-?\d+(\.\d+)?", expression):
        return float(expression) if "." in expression else int(expression)
    if not _NAME.match(expression):
        raise ValueError(f"unknown expression: {expression}")
    at = values
    for key in expression.split("."):
        at = at.get(key) if isinstance(at, dict) else getattr(at, key, None)
    return at


def _shown(expression: str, values: dict) -> str:
    name, _, rest = expression.partition("|")
    value = look_up(name, values)
    text = "" if value is None else str(value)
    if rest.strip() not in ("", "safe"):
        raise ValueError(f"unknown filter: {rest.strip()}")
    return text if rest else escape(text)


class Template:
    """A parsed template: a list of texts, expressions and blocks."""

    def __init__(self, source: str):
        pieces: list[tuple[str, str]] = []
        at = 0
        for m in _PIECE.finditer(source):
            pieces.append(("text", source[at : m.start()]))
            if m[1] is not None or m[2] is not None:
                pieces.append(("show", m[1]) if m[1] is not None else ("block", m[2]))
            at = m.end()
        pieces.append(("text", source[at:]))
        self.body, _ = self._parse(iter(pieces), ())

    def _parse(self, pieces: Iterator[tuple[str, str]], stops: tuple[str, ...]) -> tuple[list, str]:
        out: list = []
        for kind, what in pieces:
            if kind != "block":
                out.append((kind, what))
                continue
            word = what.partition(" ")[0]
            if word in stops:
                return out, what
            if word == "for":
                m = re.fullmatch(r"for\s+(\w+)\s+in\s+(\S+)", what)
                if not m:
                    raise ValueError(f"unknown block: {what}")
                body, _ = self._parse(pieces, ("endfor",))
                out.append(("for", m[1], m[2], body))
            elif word == "if":
                arms, head = [], what
                while head.partition(" ")[0] != "endif":
                    test = head.partition(" ")[2] if not head.startswith("else") else None
                    body, head = self._parse(pieces, ("elif", "else", "endif"))
                    arms.append((test, body))
                out.append(("if", arms))
            else:
                raise ValueError(f"unknown block: {what}")
        if stops:
            raise ValueError(f"missing {stops[-1]}")
        return out, ""

    def render(self, values: dict) -> str:
        return "".join(self._run(self.body, values))

    def _run(self, body: list, values: dict) -> Iterator[str]:
        for node in body:
            if node[0] == "text":
                yield node[1]
            elif node[0] == "show":
                yield _shown(node[1], values)
            elif node[0] == "for":
                for x in look_up(node[2], values) or ():
                    yield from self._run(node[3], {**values, node[1]: x})
            else:
                yield from next((self._run(b, values) for test, b in node[1] if test is None or look_up(test, values)), ())


def loader(folder: str) -> Callable[[str], Template]:
    """Templates by name from the folder; a name that leaves it is an error."""
    root = Path(folder).resolve()

    def load(name: str) -> Template:
        path = (root / name).resolve()
        if root != path and root not in path.parents:
            raise ValueError(f"outside the template folder: {name}")
        return Template(path.read_text())

    return load
