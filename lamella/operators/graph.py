"""Graph operators over a group's chunks: components, diffusion fingerprints, cluster merging, spreading activation.

Functions in plain Python work on one group (the chunks of one serial and
group, at most a few thousand words); the DataFrame functions deal the groups to
workers as rows of arrays. Components over whole tables, of any size, are a
join loop.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.digest import IMPORTANCE, LEAST_EDGE, RETENTION, SNAKE_WORDS
from ..session import written

#: What a diffusion step keeps, and what shared attributes add to a link.
DECAY, BONUS = 0.75, 3


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G1 over a whole table: id and component (its least id), isolated nodes included; labels spread by joins, doubled by jumping to the label's label."""
    both = edges.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"))
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "component-edges")
    label = written(nodes.select("id", F.col("id").alias("component")), "component-labels")
    while True:
        seen = both.join(label.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        step = label.join(seen, "id", "left").select("id", F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = step.join(step.select(F.col("id").alias("component"), F.col("component").alias("further")), "component", "left")
        new = written(jump.select("id", F.least("component", F.coalesce("further", "component")).alias("component")), "component-labels")
        if new.join(label.withColumnRenamed("component", "old"), "id").where("component <> old").limit(1).count() == 0:
            return new
        label = new


def split_components(ids: list[int], links: list[tuple[int, int]]) -> list[list[int]]:
    """Members in ascending order, components by their least member; links to others are left out."""
    top = {i: i for i in ids}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links:
        if a in top and b in top:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    out = defaultdict(list)
    for i in sorted(ids):
        out[find(i)].append(i)
    return [out[k] for k in sorted(out)]


class Component:
    """One connected component: chunks (id -> dict with words, retention, importance and a sort key) and directed links (from, to, strength)."""

    def __init__(self, chunks: dict[int, dict], links: list[tuple[int, int, str | None]]):
        self.chunks, self.ids = chunks, sorted(chunks)
        self.strength = {(a, b): s for a, b, s in links if a in chunks and b in chunks}
        self.near: dict[int, list[int]] = {i: [] for i in self.ids}
        # neighbours in the order that diffusion adds them: first those that link here, then those linked to
        for inward in (True, False):
            for a, b in self.strength:
                self.near[b if inward else a].append(a if inward else b)
        self.weight = self._weights()

    def strength_of(self, a: int, b: int) -> str | None:
        return self.strength[(a, b)] if (a, b) in self.strength else self.strength[(b, a)]

    def linked(self, a: int, b: int) -> bool:
        return (a, b) in self.strength or (b, a) in self.strength

    def _weights(self) -> dict[tuple[int, int], float]:
        """The edge weights of A3, made again from this component's links alone."""
        total: dict[int, float] = defaultdict(float)
        own = {i: RETENTION.get(c["retention"], 0) + IMPORTANCE.get(c["importance"], 0) for i, c in self.chunks.items()}
        for (a, b), s in self.strength.items():
            total[a] += IMPORTANCE.get(s, 1)
            total[b] += IMPORTANCE.get(s, 1)
        out = {}
        for (a, b), s in self.strength.items():
            v = IMPORTANCE.get(s, 1)
            out[a, b] = out[b, a] = max(own[a] * v / total[a] + own[b] * v / total[b], LEAST_EDGE)
        return out

    def fingerprints(self) -> np.ndarray:
        """From each node its concentration flows outward by layers, split by edge weight among nodes not reached yet; each row (in the order of ids) sums to one. All starts flow at once. A component lies within a group of bounded size, so the square is bounded too."""
        n = len(self.ids)
        place = {i: k for k, i in enumerate(self.ids)}
        ahead = [np.array([place[j] for j in self.near[i]], np.int64) for i in self.ids]
        weight = [np.array([self.weight[i, j] for j in self.near[i]]) for i in self.ids]
        first = np.cumsum([0, *map(len, ahead)])
        to, w = (np.concatenate(x) if n else np.zeros(0) for x in (ahead, weight))
        held, reached = np.eye(n), np.eye(n, dtype=bool)
        start, at, amount = np.arange(n), np.arange(n), np.ones(n)
        while len(at):
            count = first[at + 1] - first[at]
            of = np.repeat(np.arange(len(at)), count)
            edge = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[at], count)
            new = ~reached[start[of], to[edge]]
            of, edge = of[new], edge[new]
            share = np.bincount(of, w[edge], len(at))
            cell, back = np.unique(start[of] * n + to[edge], return_inverse=True)
            amount = np.bincount(back, amount[of] * (w[edge] / share[of]) * DECAY, len(cell))
            start, at = np.divmod(cell, max(n, 1))
            held[start, at] = amount
            reached[start, at] = True
        if not reached.all():
            raise ValueError("the component isn't connected")
        return held / held.sum(axis=1, keepdims=True)

    def link_values(self) -> dict[tuple[int, int], float]:
        """What each link is worth: likeness of the ends' fingerprints times strength and shared attributes."""
        prints = self.fingerprints()
        place = {i: k for k, i in enumerate(self.ids)}
        ends = list(self.strength)
        a, b = (np.array([place[x[k]] for x in ends], np.int64) for k in (0, 1))
        out = {}
        apart = np.concatenate([np.sqrt(((prints[a[k : k + 256]] - prints[b[k : k + 256]]) ** 2).sum(axis=1)) for k in range(0, len(ends), 256)]) if ends else np.zeros(0)
        for (i, j), d in zip(ends, apart.tolist(), strict=True):
            x, y = self.chunks[i], self.chunks[j]
            shared = BONUS * (x["retention"] is not None and y["retention"] is not None) + BONUS * (x["importance"] is not None and y["importance"] is not None)
            for p, q in ((i, j), (j, i)):
                out[p, q] = (1 - d / 2) * (IMPORTANCE.get(self.strength_of(p, q), 1) + shared)
        return out

    def value(self, left: list[int], right: set[int], links: dict[tuple[int, int], float]) -> float:
        """The least value of a link between two clusters."""
        return min((links[a, b] for a in left for b in self.near[a] if b in right), default=float("-inf"))

    def merged(self, clusters: dict[int, list[int]], links: dict, limit: int, grow_only: bool) -> dict[int, list[int]]:
        """One phase of G6. A pair is valued when it is first seen and never again; a pair that is turned down isn't tried again in the phase."""
        clusters = {k: list(v) for k, v in clusters.items()}
        of = {i: k for k, v in clusters.items() for i in v}
        words = {k: sum(self.chunks[i]["words"] for i in v) for k, v in clusters.items()}
        seen: set[tuple[int, int]] = set()
        heap: list[tuple[float, int, int]] = []

        def offer(a: int, b: int) -> None:
            pair = min(a, b), max(a, b)
            if a != b and pair not in seen:
                seen.add(pair)
                heapq.heappush(heap, (-self.value(clusters[a], set(clusters[b]), links), *pair))

        for k in sorted(clusters):
            for other in sorted({of[j] for i in clusters[k] for j in self.near[i]}):
                if k < other:
                    offer(k, other)
        while heap:
            _, a, b = heapq.heappop(heap)
            a, b = of.get(a), of.get(b)
            if a is None or b is None or a == b or not any(of[j] == b for i in clusters[a] for j in self.near[i]):
                continue
            if grow_only and len(clusters[a]) > 1 and len(clusters[b]) > 1 or words[a] + words[b] > limit:
                continue
            clusters[a] += clusters[b]
            words[a] += words.pop(b)
            for i in clusters.pop(b):
                of[i] = a
            for other in dict.fromkeys(of[j] for i in clusters[a] for j in self.near[i]):
                offer(a, other)
        return clusters

    def snakes(self, limit: int = SNAKE_WORDS) -> list[list[int]]:
        """Clusters of at most ``limit`` words, each in sentence order; a component that is small enough is one."""
        by_place = lambda v: sorted(v, key=lambda i: (*self.chunks[i]["at"], i))
        if sum(c["words"] for c in self.chunks.values()) <= limit:
            return [by_place(self.ids)]
        links = self.link_values()
        clusters = self.merged({i: [i] for i in self.ids}, links, limit, True)
        return [by_place(v) for v in self.merged(clusters, links, limit, False).values()]


SNAKES = "serial_id long, group_id long, local_snake_id int, position int, chunk_id long"


def snakes(chunks: DataFrame, edges: DataFrame, groups: DataFrame, limit: int = SNAKE_WORDS) -> DataFrame:
    """Membership of snakes. Chunks of fragments without a group and links across groups drop out; local ids start again in each group."""
    c = chunks.join(groups, ["serial_id", "fragment_id"]).select("id", "serial_id", "group_id", "fragment_id", "sentence_index", "words", "retention", "importance")
    e = edges.select("from_id", "to_id", "strength").join(c.select(F.col("id").alias("from_id"), F.col("group_id").alias("fg")), "from_id").join(c.select(F.col("id").alias("to_id"), F.col("group_id").alias("tg")), "to_id").where("fg = tg")
    out = e.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("to_id", "strength"))).alias("links"))
    whole = c.join(out, "id", "left").groupBy("serial_id", "group_id").agg(F.sort_array(F.collect_list(F.struct("id", "fragment_id", "sentence_index", "words", "retention", "importance", "links"))).alias("c"))

    def one(serial: int, group: int, rows: list[dict]) -> list[tuple]:
        keyed = {r["id"]: {"words": r["words"], "retention": r["retention"], "importance": r["importance"], "at": (serial, r["fragment_id"], r["sentence_index"])} for r in rows}
        links = [(r["id"], x["to_id"], x["strength"]) for r in rows for x in r["links"] or ()]
        made, local = [], 0
        by_component = split_components(list(keyed), [(a, b) for a, b, _ in links])
        of = {i: k for k, ids in enumerate(by_component) for i in ids}
        inside: list[list[tuple]] = [[] for _ in by_component]
        for x in links:
            inside[of[x[0]]].append(x)
        for ids, own in zip(by_component, inside, strict=True):
            for members in Component({i: keyed[i] for i in ids}, own).snakes(limit):
                made += [(serial, group, local, k, i) for k, i in enumerate(members)]
                local += 1
        return made

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("serial_id", pa.int64()), ("group_id", pa.int64()), ("local_snake_id", pa.int32()), ("position", pa.int32()), ("chunk_id", pa.int64())])
        for batch in batches:
            made = [x for r in batch.to_pylist() for x in one(r["serial_id"], r["group_id"], r["c"])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in made], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return whole.mapInArrow(run, SNAKES)


def reflect(chunks: list[tuple[int, int]], successors: dict[int, list[int]], latest: list[int], k: int, decay: float) -> list[int]:
    """Ids of the chunks that activation from the latest ones, forward along links and back, scores highest. chunks: (id, generation) in order of arrival."""
    if not chunks:
        return []
    if not latest:
        return [i for i, _ in chunks[:k]]
    new = set(latest)
    past = [(i, g) for i, g in chunks if i not in new]
    if not past:
        return []

    def spread(score: dict[int, float], queue: list[int], after) -> dict[int, float]:
        seen, at = set(queue), 0
        while at < len(queue):
            x = queue[at]
            at += 1
            ahead = sorted(after(x))
            for y in ahead:
                score[y] = score.get(y, 0.0) + score[x] / len(ahead)
                if y not in seen:
                    seen.add(y)
                    queue.append(y)
        return score

    forward = spread({i: 1 / len(latest) for i in latest}, list(latest), lambda x: successors.get(x, ()))
    backward: dict[int, list[int]] = defaultdict(list)
    for i, _ in chunks:
        for j in successors.get(i, ()):
            backward[j].append(i)
    score = spread(dict(forward), sorted(forward), lambda x: backward.get(x, ()))
    return [i for _, i in sorted((-score.get(i, 0.0) * decay**g, i) for i, g in past)[:k]]


class WorkingMemory:
    """STR3: what the next fragment sees: the current chunks, those of the fragment before (all of them), and k reflected ones."""

    def __init__(self, capacity: int = 7, decay: float = 0.5):
        self.capacity, self.decay, self.generation = capacity, decay, 0
        self.current: list[dict] = []
        self.previous: list[dict] = []
        self.extra: list[dict] = []

    def accept(self, chunks: list[dict]) -> None:
        self.current += chunks

    def finish(self, every: list[dict], successors: dict[int, list[int]]) -> None:
        by_id = {c["id"]: c for c in every}
        chosen = reflect([(c["id"], c["generation"]) for c in every], successors, [c["id"] for c in self.current], self.capacity, self.decay)
        self.previous, self.extra, self.current = self.current, [by_id[i] for i in chosen], []
        self.generation += 1

    def visible(self, with_current: bool = True) -> list[dict]:
        return (self.current if with_current else []) + self.previous + self.extra

    def prompt(self, with_current: bool = True) -> str:
        return "\n".join(f"{c['id']}. [{c['label']}] - {c['content']}" for c in self.visible(with_current)) or "(empty)"


def attention(chunks: DataFrame, edges: DataFrame, capacity: int = 7, decay: float = 0.5) -> DataFrame:
    """G12 and STR3 per serial: serial_id, fragment_id, reflected: the ids kept for the next fragment. Fragments follow each other; serials are independent."""
    links = edges.groupBy(F.col("from_id").alias("id")).agg(F.sort_array(F.collect_set("to_id")).alias("after"))
    rows = chunks.select("serial_id", "fragment_id", "id").join(links, "id", "left")

    def one(serial: pd.DataFrame) -> pd.DataFrame:
        successors = {int(r.id): [int(x) for x in r.after] for r in serial.itertuples() if r.after is not None}
        memory, every, out = WorkingMemory(capacity, decay), [], []
        for fragment, part in serial.sort_values("id").groupby("fragment_id", sort=True):
            made = [{"id": int(i), "generation": memory.generation, "label": "", "content": ""} for i in part.id]
            memory.accept(made)
            every += made
            known = {c["id"] for c in every}
            memory.finish(every, {a: [b for b in v if b in known] for a, v in successors.items() if a in known})
            out.append((int(serial.serial_id.iloc[0]), int(fragment), [c["id"] for c in memory.extra]))
        return pd.DataFrame(out, columns=["serial_id", "fragment_id", "reflected"])

    return rows.groupBy("serial_id").applyInPandas(one, "serial_id long, fragment_id long, reflected array<long>")
