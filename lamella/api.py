"""Digests as objects: make one from a source, open one, read it, export it."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from pathlib import Path
from tempfile import mkdtemp

from .functions.similarity import normalize  # noqa: F401  part of the public surface
from .operators import editor, evidence, graph, grouping, model
from .plans.digest import GROUP_WORDS, IMPORTANCE, LEAST_EDGE, RETENTION
from .sinks import export
from .sources import archive, epub, plain
from .streaming.packer import fold


class Progress:
    """STR5: what is known of a run. total grows if more is done than was announced; an error of the listener is ignored."""

    def __init__(self, listener: Callable[[dict], None] | None = None):
        self.listener, self.done, self.total = listener, 0, None

    def tell(self, **event) -> None:
        if self.listener:
            try:
                self.listener(event)
            except Exception:  # noqa: BLE001  a listener must not stop a run
                pass

    def discovered(self, serials: list[dict] | None) -> None:
        self.total = sum(s["words"] for s in serials) if serials is not None else None
        self.tell(type="serials-discovered", available=serials is not None, serials=serials or [])

    def advance(self, serial: int, words: int) -> None:
        self.done += words
        if self.total is not None:
            self.total = max(self.total, self.done)
        self.tell(type="digest-progress", serial=serial, completedWords=self.done, totalWords=self.total)


def split_fragments(text: str) -> list[list[tuple[str, int]]]:
    """(sentence, words) of each fragment."""
    rows, _ = fold(0, [text], ("", 0, 0, 0), True)
    out: list[list[tuple[str, int]]] = []
    for _, fragment, _, sentence, words in rows:
        if fragment == len(out):
            out.append([])
        out[fragment].append((sentence, words))
    return out


def graph_of(chunks: list[dict], edges: list[dict]) -> None:
    """Weights of chunks and edges, in place."""
    total: dict[int, float] = {}
    for c in chunks:
        c["weight"] = float(RETENTION.get(c["retention"], 0) + IMPORTANCE.get(c["importance"], 0))
    own = {c["id"]: c["weight"] for c in chunks}
    for e in edges:
        for i in (e["from_id"], e["to_id"]):
            total[i] = total.get(i, 0.0) + IMPORTANCE.get(e["strength"], 1)
    for e in edges:
        s = IMPORTANCE.get(e["strength"], 1)
        e["weight"] = max(sum(own[i] * s / total[i] for i in (e["from_id"], e["to_id"])), LEAST_EDGE)


def incision_scores(chunks: list[dict], edges: list[dict], words: dict[int, int]) -> list[tuple[int, int, int, int]]:
    """(fragment, words, start, end) with scores from 0 to 10, for one serial (A4 to A8 without Spark)."""
    import math

    place = {c["id"]: c["fragment_id"] for c in chunks}
    start, end = dict.fromkeys(sorted(set(place.values())), 0.0), dict.fromkeys(sorted(set(place.values())), 0.0)
    far: dict[int, list[tuple[int, float]]] = {}
    for e in edges:
        a, b = e["from_id"], e["to_id"]
        if a in place and b in place and place[a] != place[b]:
            far.setdefault(a, []).append((place[b], e["weight"]))
            far.setdefault(b, []).append((place[a], e["weight"]))
    for c in chunks:
        total = sum(w for _, w in far.get(c["id"], ()))
        for other, w in far.get(c["id"], ()) if total else ():
            (start if other < c["fragment_id"] else end)[c["fragment_id"]] += c["weight"] / total * w
    values = sorted(round(v, 9) for v in (*start.values(), *end.values()) if v > 0)
    limit = values[min(int(len(values) * 0.98), len(values) - 1)] if values else 0
    low = [v for v in values if v < limit]

    def scale(v: float) -> int:
        v = round(v, 9)
        if v <= 0 or not values:
            return 0
        if not low or v >= limit:
            return 10
        span = math.log(low[-1]) - math.log(low[0]) or 1
        return max(1, min(10, math.floor(1 + (math.log(v) - math.log(low[0])) / span * 9 + 0.5)))

    return [(f, words.get(f, 0), scale(start[f]), scale(end[f])) for f in start]


class Digest:
    """An open digest (a folder, or an unpacked archive)."""

    def __init__(self, folder: archive.Folder):
        self.folder = folder

    @classmethod
    def open(cls, path: str) -> Digest:
        return cls(archive.Folder.unpacked(path) if Path(path).is_file() else archive.Folder(path))

    def meta(self) -> dict | None:
        return self.folder.sidecar("book-meta.json")

    def cover(self) -> dict | None:
        return self.folder.cover()

    def toc(self) -> list[dict]:
        return (self.folder.sidecar("toc.json") or {"items": []})["items"]

    def serials(self) -> list[dict]:
        return [{"id": x["serialId"], "title": x["title"], "path": list(path), "depth": depth, "fragments": len(self.folder.fragment_ids(x["serialId"]))} for depth, path, x in export.preorder(self.toc()) if "serialId" in x]

    def summary(self, serial: int) -> str:
        if serial not in {s["id"] for s in self.serials()}:
            raise KeyError(f"no serial {serial}")
        text = self.folder.summary(serial)
        if text is None:
            raise KeyError(f"no summary of serial {serial}")
        return text

    def export_text(self, path: str) -> None:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text(export.plain_text(self.toc(), self.folder.summary))

    def export_epub(self, path: str) -> None:
        export.epub(path, self.meta() or {}, self.toc(), self.folder.summary, self.cover())

    def save_as(self, path: str) -> list[str]:
        return archive.write(str(self.folder.path), path)


class App:
    """Makes digests. extract(sentences, visible) returns a batch of chunks and links; ask and review are the editor's two questions."""

    def __init__(self, extract=model.lexical_extract, ask=None, review=None, listener=None, language: str | None = None, capacity: int = 7):
        self.extract, self.language, self.capacity = extract, language, capacity
        self.ask = ask or (lambda kind, x: " ".join(x["text"].split()[: max(1, len(x["text"].split()) // 5)]))
        self.review = review or (lambda text, clue: [])
        self.progress = Progress(listener)

    def digest_file(self, path: str, folder: str | None = None) -> Digest:
        kind = plain.infer_format(path)
        if kind == "archive":
            return Digest.open(path)
        if kind == "epub":
            book = epub.Book(Path(path).read_bytes())
            texts = book.texts()
            fill = lambda nodes: [{"title": n["title"], "text": texts.get(n["id"]) or None, "children": fill(n["children"])} for n in nodes]
            return self._digest(fill(book.sections()), book.metadata(), book.cover(), folder)
        return self._digest(plain.sections(path, Path(path).read_text()), plain.metadata(path, kind), None, folder)

    def digest_text(self, text: str, title: str | None = None, folder: str | None = None) -> Digest:
        self.progress.discovered(None)
        return self._digest([{"title": title, "text": text, "children": []}], {**plain.metadata("", "txt"), "title": title}, None, folder, announce=False)

    def _digest(self, sections: list[dict], meta: dict, cover: dict | None, folder: str | None, announce: bool = True) -> Digest:
        out = archive.Folder(folder or mkdtemp(prefix="lamella-digest-"))
        toc, order = export.plan(sections, meta.get("title"))
        cut = {serial: split_fragments(s["text"]) for serial, s in order}
        if announce:
            self.progress.discovered([{"id": k, "fragments": len(v), "words": sum(n for f in v for _, n in f)} for k, v in cut.items()])
        for serial, _ in order:
            self._serial(out, serial, cut[serial])
        out.sidecar("book-meta.json", meta)
        out.sidecar("toc.json", {"version": 1, "items": toc})
        if cover:
            out.set_cover(cover)
        return Digest(out)

    def _serial(self, out: archive.Folder, serial: int, fragments: list[list[tuple[str, int]]]) -> None:
        memory, chunks, edges = graph.WorkingMemory(self.capacity), [], []
        ids_ = itertools.count(out.db.execute("SELECT COALESCE(MAX(id), 0) + 1 FROM chunks").fetchone()[0])
        for number, sentences in enumerate(fragments):
            texts = [t for t, _ in sentences]
            batch = self.extract(texts, memory.visible(False))
            kept, at = [], []
            for c in batch["chunks"]:
                try:
                    found = evidence.resolve(c["evidence"], texts)["indexes"]
                except evidence.Open:
                    found = evidence.legacy_match([c["content"]], texts) or list(range(len(texts)))
                kept.append(c)
                at.append(found)
            made, links = model.accept({"chunks": kept, "links": batch["links"]}, memory, lambda: next(ids_))
            for c, found in zip(made, at, strict=True):
                c |= {"serial_id": serial, "fragment_id": number, "sentence_index": found[0], "sentences": [(number, i) for i in found], "words": sum(sentences[i][1] for i in found)}
            chunks += made
            edges = list({(e["from_id"], e["to_id"]): e for e in [*edges, *links]}.values())
            out.fragment(serial, number, [{"text": t, "wordsCount": n} for t, n in sentences], batch.get("fragment_summary", ""))
            memory.finish(chunks, _successors(edges))
            self.progress.advance(serial, sum(n for _, n in sentences))
        graph_of(chunks, edges)
        words = {k: sum(n for _, n in f) for k, f in enumerate(fragments)}
        groups = grouping.split(incision_scores(chunks, edges, words), GROUP_WORDS)
        out.put("serials", [(serial,)])
        out.put("serial_states", [(serial, 1)])
        out.put("chunks", [(c["id"], c["generation"], serial, c["fragment_id"], c["sentence_index"], c["label"], c["content"], c["retention"], c["importance"], c["words"], c["weight"]) for c in chunks])
        out.put("chunk_sentences", [(c["id"], serial, f, i) for c in chunks for f, i in c["sentences"]])
        out.put("knowledge_edges", [(e["from_id"], e["to_id"], e["strength"], e["weight"]) for e in edges])
        out.put("fragment_groups", [(serial, g, f) for g, ids in enumerate(groups) for f in ids])
        by_id = {c["id"]: c for c in chunks}
        texts = []
        for g, ids in enumerate(groups):
            found = self._snakes(out, serial, g, [c for c in chunks if c["fragment_id"] in set(ids)], edges)
            clues = grouping.merge_clues([{"id": s, "label": f"{by_id[m[0]]['label']} -> {by_id[m[-1]]['label']}", "weight": sum(by_id[i]["weight"] for i in m), "fragments": {f for i in m for f, _ in by_id[i]["sentences"]}, "chunks": [((by_id[i]["fragment_id"], by_id[i]["sentence_index"]), i) for i in m], "sources": [s]} for s, m in found])
            text = editor.book({f: [t for t, _ in fragments[f]] for f in ids}, ids, [c for c in chunks if c["fragment_id"] in set(ids)], high=True)
            texts.append(editor.compress(text, clues, self.ask, self.review, self.language)["text"])
        out.summary(serial, editor.assemble(texts))

    @staticmethod
    def _snakes(out: archive.Folder, serial: int, group: int, chunks: list[dict], edges: list[dict]) -> list[tuple[int, list[int]]]:
        keyed = {c["id"]: {"words": c["words"], "retention": c["retention"], "importance": c["importance"], "at": (c["fragment_id"], c["sentence_index"])} for c in chunks}
        links = [(e["from_id"], e["to_id"], e["strength"]) for e in edges if e["from_id"] in keyed and e["to_id"] in keyed]
        by_id, found = {c["id"]: c for c in chunks}, []
        first = out.db.execute("SELECT COALESCE(MAX(id), 0) + 1 FROM snakes").fetchone()[0]
        for ids in graph.split_components(list(keyed), [(a, b) for a, b, _ in links]):
            for members in graph.Component({i: keyed[i] for i in ids}, [x for x in links if x[0] in set(ids)]).snakes():
                found.append((first + len(found), members))
        out.put("snakes", [(s, serial, group, k, len(m), by_id[m[0]]["label"], by_id[m[-1]]["label"], sum(by_id[i]["words"] for i in m), sum(by_id[i]["weight"] for i in m)) for k, (s, m) in enumerate(found)])
        out.put("snake_chunks", [(s, i, k) for s, m in found for k, i in enumerate(m)])
        of = {i: s for s, m in found for i in m}
        at = {s: (*keyed[m[0]]["at"], m[0]) for s, m in found}
        weight: dict[tuple[int, int], float] = {}
        for e in edges:
            a, b = of.get(e["from_id"]), of.get(e["to_id"])
            if a and b and a != b:
                pair = (a, b) if at[a] < at[b] else (b, a)
                weight[pair] = weight.get(pair, 0.0) + e["weight"]
        out.put("snake_edges", [(a, b, w) for (a, b), w in sorted(weight.items())])
        return found


def _successors(edges: list[dict]) -> dict[int, list[int]]:
    """Newer to older links by their newer end."""
    out: dict[int, set[int]] = {}
    for e in edges:
        out.setdefault(e["from_id"], set()).add(e["to_id"])
    return {k: sorted(v) for k, v in out.items()}


def info(digest: Digest) -> str:
    meta = digest.meta() or {}
    return "\n".join([f"title: {meta.get('title') or '(none)'}", f"authors: {', '.join(meta.get('authors', [])) or '(none)'}", f"serials: {len(digest.serials())}", f"fragments: {sum(s['fragments'] for s in digest.serials())}", f"cover: {'yes' if digest.cover() else 'no'}", json.dumps({"language": meta.get("language")})])
