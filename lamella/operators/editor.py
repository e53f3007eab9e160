"""The compress and review loop (L12 to L16), its scores and its markup."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from ..functions.language import detect

#: What an issue costs, and the order of attributes.
SEVERITY = {"critical": 9, "major": 3, "minor": 1}
RETENTION_ORDER = {"verbatim": 4, "detailed": 3, "focused": 2, "relevant": 1}
IMPORTANCE_ORDER = {"critical": 3, "important": 2, "helpful": 1}
SHOWN_ISSUES, ROUNDS, RATIO = 9, 5, 0.2
_TAG = re.compile(r"<chunk(?:\s+[^>]*)?>|</chunk>")
_SECTION = re.compile(r"##\s*(?:Compressed\s+Text|压缩文本)\s*\n+(.*?)(?:\n+---|\*\*CRITICAL\*\*|\Z)", re.I | re.S)
_HEADING = re.compile(r"##\s*(?:Compressed\s+Text|压缩文本)\s*", re.I)
_FENCE = re.compile(r"\A```(?:\w+)?\s*\n(.*?)\n```\Z", re.S)


def score_reviews(reviews: Iterable[dict]) -> float:
    """Reviews have a weight and issues with a severity."""
    return sum(SEVERITY[i["severity"]] * r["weight"] for r in reviews for i in r["issues"])


def best_version(versions: list[dict]) -> dict:
    """The least score, the first of equals."""
    if not versions:
        raise ValueError("no version was made")
    return min(versions, key=lambda v: v["score"])


def issue_lines(reviews: list[dict], most: int | None = SHOWN_ISSUES) -> str:
    """Issues by severity, then weight; those beyond the limit are counted."""
    issues = sorted(((r["weight"], i) for r in reviews for i in r["issues"]), key=lambda x: (-SEVERITY[x[1]["severity"]], -x[0]))
    lines = []
    for n, (_, issue) in enumerate(issues[:most], 1):
        lines += [f"{n}. [{issue['severity'].upper()}]", f"   Problem: {issue['problem']}"]
        if issue.get("suggestion"):
            lines.append(f"   Suggestion: {issue['suggestion']}")
        lines.append("")
    hidden = len(issues) - len(issues[:most])
    return "\n".join(lines + ([f"({hidden} lesser issues not shown)"] if hidden else []))


def strip_tags(text: str) -> str:
    return _TAG.sub("", text)


def compressed_text(response: str) -> str:
    m = _SECTION.search(response)
    text = (m[1] if m else response).strip()
    fence = _FENCE.match(text)
    return fence[1].strip() if fence else text


def thinking_text(response: str) -> str:
    m = _HEADING.search(response)
    return response[: m.start()].strip() if m else ""


def marks(chunks: list[dict]) -> dict:
    """The attributes of a sentence that several chunks cover; the first of equals wins, retention before importance."""
    r = max(chunks, key=lambda c: RETENTION_ORDER.get(c.get("retention"), 0))
    i = max(chunks, key=lambda c: IMPORTANCE_ORDER.get(c.get("importance"), 0))
    by_retention = RETENTION_ORDER.get(r.get("retention"), 0) >= IMPORTANCE_ORDER.get(i.get("importance"), 0)
    return {"label": (r if by_retention else i)["label"], "retention": r.get("retention"), "importance": i.get("importance")}


def markup(sentences: list[str], cover: dict[int, list[dict]], full: bool = False, high: bool = False) -> str:
    """The sentences of a fragment, neighbours with the same label in one tag (full: with all attributes; high: only verbatim and detailed)."""
    parts, i = [], 0
    while i < len(sentences):
        if i not in cover:
            parts.append(sentences[i])
            i += 1
            continue
        m, j = marks(cover[i]), i + 1
        while j < len(sentences) and j in cover and marks(cover[j])["label"] == m["label"]:
            j += 1
        text = " ".join(sentences[i:j])
        if full:
            names = "".join(f' {k}="{m[k]}"' for k in ("label", "retention", "importance") if m[k] is not None)
            text = f"<chunk{names}>{text}</chunk>"
        elif high and m["retention"] in ("verbatim", "detailed"):
            text = f'<chunk retention="{m["retention"]}">{text}</chunk>'
        parts.append(text)
        i = j
    return " ".join(parts)


def book(fragments: dict[int, list[str]], listed: list[int], chunks: list[dict], full: bool = False, high: bool = False, summaries: dict[int, str] | None = None) -> str:
    """The listed fragments, a blank line between them. summaries: texts for fragments that are skipped (left out unless given)."""
    cover: dict[int, dict[int, list[dict]]] = {}
    for c in chunks:
        for fragment, sentence in c["sentences"]:
            cover.setdefault(fragment, {}).setdefault(sentence, []).append(c)
    parts: list[str] = []
    for k, fragment in enumerate(listed):
        if k and summaries:
            skipped = " ".join(filter(None, (summaries.get(x, "").strip() for x in range(listed[k - 1] + 1, fragment))))
            parts += [skipped] if skipped else []
        parts.append(markup(fragments[fragment], cover.get(fragment, {}), full, high))
    return "\n\n".join(parts)


def compress(text: str, clues: list[dict], ask: Callable[[str, dict], str], review: Callable[[str, dict], list[dict]], language: str | None = None, rounds: int = ROUNDS, ratio: float = RATIO) -> dict:
    """Compress, review by every clue, and again with the feedback, until no issue is left or the rounds are over; the best version is returned."""
    if not text.strip():
        return {"iteration": 0, "text": "", "score": 0.0}
    versions, feedback, before = [], "", ""
    for n in range(1, rounds + 1):
        made = strip_tags(compressed_text(ask("compress", {"text": text, "target": int(len(text) * ratio), "feedback": feedback, "previous": before})))
        reviews = [{"weight": c["weight"], "issues": review(made, c)} for c in clues]
        said = detect(made)
        if language and said and said != language:
            reviews.append({"weight": 1.0, "issues": [{"problem": f"The text is in {said}, not in {language}.", "severity": "critical", "suggestion": f"Write in {language}."}]})
        versions.append({"iteration": n, "text": made, "score": score_reviews(reviews)})
        if versions[-1]["score"] == 0:
            break
        feedback, before = issue_lines(reviews), made
    return best_version(versions)


def assemble(groups: list[str]) -> str:
    """The groups' texts in order, blank ones left out."""
    return "\n\n".join(x.strip() for x in groups if x.strip())
