"""The translation guard (L11): chunks in another language than the wanted one are translated, and nothing else changes."""

from __future__ import annotations

import json
from collections.abc import Callable

from ..functions.language import needs_translation
from .guard import Invalid, Refused, ask_json

RETRIES = 3


def _issues(value, wanted: list[int]) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, dict) for x in value):
        return ["the answer is a list of objects"]
    ids = [x.get("id") for x in value]
    out = [] if sorted(map(str, ids)) == sorted(map(str, wanted)) else [f"the ids must be {wanted}, each once"]
    return out + [f"{x.get('id')}: {k} is empty" for x in value for k in ("label", "content") if not str(x.get(k) or "").strip()]


def translated(chunks: list[dict], language: str, ask: Callable[[list[dict]], str], retries: int = RETRIES) -> list[dict]:
    """The chunks (label, content and more) in their order. The model sees only those that need it; if no answer fits within the retries, all stay as they are."""
    foreign = [k for k, c in enumerate(chunks) if needs_translation(c["label"], c["content"], language)]
    if not foreign:
        return chunks
    said = json.dumps([{"id": k, "label": chunks[k]["label"], "content": chunks[k]["content"]} for k in foreign], ensure_ascii=False)
    messages = [{"role": "system", "content": f"Translate label and content into {language}. Answer with a JSON list of the same ids."}, {"role": "user", "content": said}]
    try:
        answer = ask_json(ask, messages, lambda v: _issues(v, foreign), lambda v: {int(x["id"]): x for x in v}, retries)
    except (Invalid, Refused):
        return chunks
    return [{**c, "label": answer[k]["label"], "content": answer[k]["content"]} if k in answer else c for k, c in enumerate(chunks)]
