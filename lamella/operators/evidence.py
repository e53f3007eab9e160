"""Quotation to sentence: anchors are parsed, sentences ranked, and one of them chosen or the case left open (SIM10 to SIM16)."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.similarity import normalize, score

#: Fixed values of the decision.
LEAST_SCORE, SURE_SCORE, GOOD_SCORE, LEAST_GAP, LEAST_SUBSTRING, SHOWN = 0.55, 0.97, 0.9, 0.07, 8, 3
_SENTENCE = re.compile(r"[^.!?。！？\n]+[.!?。！？]*")
START, END = "start_anchor", "end_anchor"


#: Every quotation of a serial is held against the same sentences.
_normal = lru_cache(1 << 16)(normalize)


class Open(Exception):
    """No sentence could be chosen: code, field and the candidates to choose from."""

    def __init__(self, code: str, field: str, candidates: list[dict] = ()):
        super().__init__(f"{field}: {code}")
        self.code, self.field, self.candidates = code, field, list(candidates)[:SHOWN]


def split_sentences(text: str) -> list[str]:
    return [x.strip() for x in _SENTENCE.findall(text) if x.strip()]


def parse_anchor(value, field: str) -> str:
    """The text to look for. A quotation with "..." or with head and tail is cut to its side at the field; of several sentences the outer one counts."""
    if isinstance(value, str):
        whole = value.strip()
        parts = [x.strip() for x in whole.split("...") if x.strip()] if "..." in whole else []
        pair = (parts[0], parts[-1]) if len(parts) > 1 else (whole, whole)
    elif isinstance(value, dict):
        text_of = lambda k: value[k].strip() if isinstance(value.get(k), str) else ""
        if value.get("mode") == "head_tail" or "head" in value:
            head, tail = text_of("head"), text_of("tail")
            pair = (head or tail, tail or head)
        else:
            pair = (text_of("text"),) * 2
    else:
        raise Open("invalid_anchor", field)
    chosen = pair[1] if field == END else pair[0]
    if not chosen:
        raise Open("invalid_anchor", field)
    sentences = split_sentences(chosen)
    return (sentences[-1] if field == END else sentences[0]) if len(sentences) > 1 else chosen.strip()


def rank(anchor: str, texts: list[str], field: str, only: set[int] | None = None) -> list[dict]:
    """All sentences (or those of the given indexes), best first: by score, then equal, contained, equal when normalised, then position."""
    found = [{**score(anchor, t, field), "index": i, "text": t, "prev": texts[i - 1] if i else "", "next": texts[i + 1] if i + 1 < len(texts) else ""} for i, t in enumerate(texts) if only is None or i in only]
    return sorted(found, key=lambda c: (-c["score"], not c["raw"], not c["substring"], not c["normalized"], c["index"]))


def head_tail_score(head: str, tail: str, candidate: str) -> float:
    """SIM10, by direct call only: a sentence that begins with head and ends with tail somewhere, in order."""
    h, t, c = normalize(head), normalize(tail), normalize(candidate)
    if not h or not t:
        return 0.0
    at, last = c.find(h), c.rfind(t)
    if 0 <= at <= last:
        return 0.82 + 0.18 * min(1, (len(h) + len(t)) / max(1, len(c)))
    a, b = score(head, candidate, START), score(tail, candidate, END)
    return (a["score"] + b["score"]) / 2 * (1 if a["start"] <= b["start"] else 0.85)


def resolve_anchor(anchor: str, texts: list[str], field: str, first: int = 0) -> tuple[dict, str]:
    """The sentence and how it was found; Open otherwise. The window search runs only if no sentence holds the anchor."""
    plain, want = _normal(anchor), anchor.strip()
    held = [i for i, t in enumerate(texts) if plain and plain in _normal(t)]
    clear = lambda cs: cs[0]["score"] >= GOOD_SCORE and cs[0]["score"] - cs[1]["score"] >= LEAST_GAP
    if held:
        known = [c for c in rank(anchor, texts, field, set(held)) if c["index"] >= first]
        raw = [c for c in known if c["text"].strip() == want]
        if len(raw) == 1:
            return raw[0], "exact_raw"
        if raw:
            raise Open("ambiguous_exact_raw", field, raw)
        kinds = [("substring", "exact_substring")] if len(plain) >= LEAST_SUBSTRING else []
        for flag, name in [*kinds, ("normalized", "exact_normalized")]:
            same = [c for c in known if c[flag]]
            if len(same) == 1:
                return same[0], name
            if same and clear(same):
                return same[0], f"{name}_scored"
            if same:
                raise Open(f"ambiguous_{name}", field, same)
    ranked = [c for c in rank(anchor, texts, field) if c["index"] >= first]
    if not ranked:
        raise Open("none", field)
    if ranked[0]["score"] < LEAST_SCORE:
        raise Open("low_confidence", field, ranked)
    if len(ranked) == 1:
        return ranked[0], "auto_top1_single_candidate"
    if ranked[0]["score"] >= SURE_SCORE:
        return ranked[0], "auto_top1_very_high"
    if clear(ranked):
        return ranked[0], "auto_top1"
    raise Open("ambiguous_ranked", field, ranked)


def resolve(evidence: dict, texts: list[str], chosen: dict | None = None) -> dict:
    """indexes (contiguous), confidence and strategy of the sentences that an evidence names; chosen: field -> candidate picked by hand (or by a second question)."""
    chosen = chosen or {}
    start = evidence.get(START, evidence.get("start"))
    end = evidence.get(END, evidence.get("end"))
    one = lambda value, field, first=0: (chosen[field], "choice_final") if field in chosen else resolve_anchor(parse_anchor(value, field), texts, field, first)
    parse_anchor(start, START)
    if end is not None:
        parse_anchor(end, END)
    a, how = one(start, START)
    if end is None:
        return {"indexes": [a["index"]], "confidence": a["score"], "strategy": how}
    b, how_b = one(end, END, a["index"])
    if b["index"] < a["index"]:
        raise Open("invalid_range", END)
    return {"indexes": list(range(a["index"], b["index"] + 1)), "confidence": min(a["score"], b["score"]), "strategy": f"{how}+{how_b}"}


def resolve_choice(reply: str, texts: list[str]) -> int | None:
    """The index of "S3" in a reply to the second question, if it names a sentence."""
    m = re.search(r"\bS(\d+)\b", reply)
    return int(m[1]) - 1 if m and 1 <= int(m[1]) <= len(texts) else None


def legacy_match(quotes: list[str], texts: list[str]) -> list[int]:
    """SIM16: each quotation by equality, then normalised equality, then a run of sentences that spell it, then containment; only unique finds count."""
    norm = [normalize(t) for t in texts]
    out: list[int] = []
    for quote in quotes:
        q = normalize(quote)
        spans = [[i] for i, t in enumerate(texts) if t.strip() == quote.strip()]
        spans = spans if len(spans) == 1 else [[i] for i, t in enumerate(norm) if q and t == q]
        if len(spans) != 1 and q:
            spans = []
            for i in range(len(norm)):
                made, j = "", i
                while j < len(norm) and len(made) < len(q) and q.startswith(made):
                    made += norm[j]
                    j += 1
                if made == q and j > i:
                    spans.append(list(range(i, j)))
        if len(spans) != 1 and q:
            spans = [[i] for i, t in enumerate(norm) if q in t]
        if len(spans) == 1:
            out += [i for i in spans[0] if i not in out]
    return out


RESOLVED = "serial_id long, quote_id long, indexes array<int>, confidence double, strategy string, problem string"


def resolve_all(sentences: DataFrame, quotes: DataFrame) -> DataFrame:
    """Every quotation (serial_id, quote_id, start, end) against the sentences (serial_id, sidx, text) of its serial: one row per serial goes to a worker, with its sentences once."""
    texts = sentences.groupBy("serial_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("sidx", "text"))), lambda x: x["text"]).alias("texts"))
    asked = quotes.groupBy("serial_id").agg(F.sort_array(F.collect_list(F.struct("quote_id", "start", "end"))).alias("asked"))

    def run(parts):
        for part in parts:
            rows = []
            for serial, among, every in zip(part.serial_id, part.texts, part.asked, strict=True):
                among = list(among)
                for q in every:
                    evidence = {START: q["start"]} | ({END: q["end"]} if q["end"] is not None else {})
                    try:
                        x = resolve(evidence, among)
                        rows.append((serial, q["quote_id"], x["indexes"], x["confidence"], x["strategy"], None))
                    except Open as e:
                        rows.append((serial, q["quote_id"], [], 0.0, None, f"{e.field}:{e.code}"))
            yield pd.DataFrame(rows, columns=["serial_id", "quote_id", "indexes", "confidence", "strategy", "problem"])

    return asked.join(texts, "serial_id").mapInPandas(run, RESOLVED)
