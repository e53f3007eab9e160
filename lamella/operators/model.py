"""Calling a model: retries, sampling schedule, and a cache that is a table (L1 to L5, L7). No provider is built in; a client is any callable."""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RETRIES, INTERVAL = 5, 6.0
#: What is worth another try.
HTTP = frozenset((408, 409, 425, 429, 500, 502, 503, 504, 520, 522, 524, 529))
CODES = frozenset("ECONNRESET ECONNREFUSED ETIMEDOUT EPIPE ENOTFOUND EAI_AGAIN EHOSTUNREACH ENETUNREACH".split())
TEXTS = ("timeout", "timed out", "network", "connection", "overloaded")


def sampled(value: float | list[float] | None, retry: int, most: int) -> float | None:
    """A number, or two between which retries move in even steps."""
    if value is None or isinstance(value, int | float):
        return value
    if len(value) != 2:
        raise ValueError("a schedule has two numbers")
    part = 0.0 if most <= 0 else min(1.0, max(0.0, retry / most))
    return value[0] + (value[1] - value[0]) * part


def retryable(error: Exception) -> bool:
    if type(error).__name__ in ("AbortError", "CancelledError") or "abort" in str(error).lower():
        return False
    if getattr(error, "retryable", None) is not None:
        return bool(error.retryable)
    return getattr(error, "status", None) in HTTP or getattr(error, "code", None) in CODES or any(x in str(error).lower() for x in TEXTS)


def with_retries(call: Callable[[int], str], retries: int = RETRIES, interval: float = INTERVAL, sleep: Callable[[float], None] = time.sleep) -> str:
    for attempt in range(retries + 1):
        try:
            return call(attempt)
        except Exception as e:
            if attempt == retries or not retryable(e):
                raise
            sleep(interval)
    raise AssertionError


def cache_key(messages: list[dict], model: str, provider: str, temperature: float | None = None, top_p: float | None = None) -> str:
    """L3: SHA-512 of the request in canonical JSON."""
    request = {"messages": messages, "modelId": model, "provider": provider, "temperature": temperature, "topP": top_p}
    return hashlib.sha512(json.dumps({k: v for k, v in request.items() if v is not None}, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


class Scripted:
    """Answers given beforehand, in order; remembers what was asked."""

    def __init__(self, answers: list[str]):
        self.answers, self.asked = deque(answers), []

    def __call__(self, messages: list[dict]) -> str:
        self.asked.append(messages)
        if not self.answers:
            raise RuntimeError("the script is over")
        return self.answers.popleft()


def complete(requests: DataFrame, cache: DataFrame, call: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """(answers, new cache rows) for requests (key, prompt). What the cache (key, response) has isn't asked again; the caller writes the new rows when its work has succeeded."""
    missing = requests.join(cache.select("key"), "key", "left_anti").dropDuplicates(["key"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"key": part.key, "response": [with_retries(lambda _, p=p: call(p)) for p in part.prompt]})

    new = missing.mapInPandas(run, "key string, response string")
    return requests.join(cache.unionByName(new), "key", "left"), new


def lexical_extract(sentences: list[str], visible: list[dict], every: int = 3) -> dict:
    """A stand-in for a model: every third sentence is a chunk, linked to the one before and to visible chunks that share a long word."""
    chunks, links = [], []
    for n, k in enumerate(range(0, len(sentences), every)):
        text = sentences[k]
        size = len(text.split())
        chunks.append({"temp_id": f"t{n}", "label": text[:24], "content": text, "retention": ("verbatim", "detailed", "focused", "relevant", None)[size % 5], "evidence": {"start_anchor": text}})
        if n:
            links.append({"from": f"t{n}", "to": f"t{n - 1}", "strength": ("critical", "important", "helpful")[size % 3]})
        long = set(re.findall(r"\w{8,}", text.lower()))
        links += [{"from": f"t{n}", "to": v["id"], "strength": "helpful"} for v in visible if long & set(re.findall(r"\w{8,}", v["content"].lower()))]
    return {"fragment_summary": sentences[0] if sentences else "", "chunks": chunks, "links": links}


def validate_batch(batch: dict, visible: set[int], texts: list[str]) -> list[str]:
    """What is wrong with an extraction: empty fields, evidence that can't be found, links to chunks that aren't visible."""
    from .evidence import Open, resolve

    issues = []
    for n, c in enumerate(batch.get("chunks", []), 1):
        issues += [f"chunk {n}: {k} is empty" for k in ("label", "content") if not str(c.get(k, "")).strip()]
        try:
            resolve(c.get("evidence", {}), texts)
        except Open as e:
            issues.append(f"chunk {n}: {e}")
    for x in batch.get("links", []):
        issues += [f"link to {x[k]}: not visible" for k in ("from", "to") if isinstance(x[k], int) and x[k] not in visible]
    return issues


def accept(batch: dict, memory, next_id: Callable[[], int]) -> tuple[list[dict], list[dict]]:
    """Chunks with ids and the links between them and visible ones, from the larger id to the smaller; references to nothing are left out."""
    temp = {}
    chunks = []
    for c in batch["chunks"]:
        made = {"id": next_id(), "generation": memory.generation, **{k: c.get(k) for k in ("label", "content", "retention", "importance")}}
        chunks.append(made)
        if c.get("temp_id"):
            temp[c["temp_id"]] = made["id"]
    known = {c["id"] for c in memory.visible()} | {c["id"] for c in chunks}
    edges = []
    for x in batch["links"]:
        ends = [temp.get(v) if isinstance(v, str) else v if v in known else None for v in (x["from"], x["to"])]
        if None not in ends:
            edges.append({"from_id": max(ends), "to_id": min(ends), "strength": x.get("strength")})
    memory.accept(chunks)
    return chunks, edges


def key_column(content, role):
    return F.sha2(F.to_json(F.struct(content.alias("content"), role.alias("role"))), 512)
