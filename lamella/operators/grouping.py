"""Fragment groups (G10, G11, W6) and clue merging."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.digest import GROUP_WORDS

MOST_CLUES = 10


def in_order(sizes: list[int], limit: int) -> list[list[int]]:
    """Indexes packed in order; a group closes before it would exceed the limit and as soon as it reaches it."""
    out: list[list[int]] = []
    room = 0
    for i, n in enumerate(sizes):
        if not out or room <= 0 or n > room:
            out.append([])
            room = limit
        out[-1].append(i)
        room -= n
    return out


def split(infos: list[tuple[int, int, int, int]], limit: int) -> list[list[int]]:
    """Fragment ids of each group. infos: (fragment_id, words, start, end) in order.

    Too much for one group is cut at the boundary (end of one plus start of the next, above zero) that leaves the fewest sides too large, then
    the highest, then the one with the least excess; without such a boundary it is packed in order.
    """
    if limit <= 0:
        return [[x[0]] for x in infos]
    groups: list[list[int]] = []
    todo = [infos] if infos else []
    while todo:
        part = todo.pop()
        total = sum(x[1] for x in part)
        if len(part) == 1 or total <= limit:
            groups.append([x[0] for x in part])
            continue
        left, options = 0, []
        for i in range(len(part) - 1):
            left += part[i][1]
            height = part[i][3] + part[i + 1][2]
            if height > 0:
                over = max(0, left - limit), max(0, total - left - limit)
                options.append(((over[0] > 0) + (over[1] > 0), -height, sum(over), i))
        if options:
            at = min(options)[3] + 1
            todo += [part[at:], part[:at]]
        else:
            groups += [[part[i][0] for i in g] for g in in_order([x[1] for x in part], limit)]
    return groups


def fragment_groups(scored: DataFrame, limit: int = GROUP_WORDS) -> DataFrame:
    """serial_id, group_id, fragment_id by the incision-guided split. A serial that fits one group stays with Spark; of the others each is one array for a worker."""
    info = F.struct("fragment_id", F.col("words_count").cast("long"), F.col("start_incision").cast("long"), F.col("end_incision").cast("long"))
    listed = scored.groupBy("serial_id").agg(F.sort_array(F.collect_list(info)).alias("f"), F.sum("words_count").alias("total"))
    zero = F.lit(0).cast("long")
    whole = listed.where((F.col("total") <= limit) & F.lit(limit > 0)).select("serial_id", zero.alias("group_id"), F.explode("f.fragment_id").alias("fragment_id"))
    of = F.pandas_udf(lambda f: f.map(lambda x: [g for g, ids in enumerate(split([tuple(y.values()) for y in x], limit)) for _ in ids]), "array<bigint>")
    # groups keep the order of the fragments, so the n-th number belongs to the n-th fragment
    rest = listed.where((F.col("total") > limit) | F.lit(limit <= 0)).select("serial_id", F.explode(F.arrays_zip(of("f").alias("g"), F.col("f.fragment_id").alias("i"))).alias("x"))
    return whole.select("serial_id", "group_id", F.col("fragment_id").cast("long").alias("fragment_id")).unionByName(rest.select("serial_id", F.col("x.g").alias("group_id"), F.col("x.i").cast("long").alias("fragment_id")))


def merge_clues(clues: list[dict], most: int = MOST_CLUES) -> list[dict]:
    """While there are too many, the two light ones that share most fragments become one. clues: id, label, weight, fragments (set), chunks (list of (place, id)), sources."""
    clues, new = list(clues), -1
    while len(clues) > most:
        clues.sort(key=lambda c: -c["weight"])
        light = clues[math.floor(most * 0.75) :]
        if len(light) < 2:
            break
        best, pair = -1, None
        for i, a in enumerate(light):
            for b in light[i + 1 :]:
                shared = len(a["fragments"] & b["fragments"])
                if shared > best:
                    best, pair = shared, (a, b)
        a, b = pair
        sources = sorted(a["sources"] + b["sources"])
        joined = {"id": new, "label": f"Merged minor clues ({len(sources)})", "weight": a["weight"] + b["weight"], "fragments": a["fragments"] | b["fragments"], "chunks": sorted(a["chunks"] + b["chunks"]), "sources": sources}
        clues = [c for c in clues if c is not a and c is not b] + [joined]
        new -= 1
    total = sum(c["weight"] for c in clues)
    return sorted(({**c, "weight": c["weight"] / total if total else 0.0} for c in clues), key=lambda c: -c["weight"])


def clues(members: DataFrame, chunks: DataFrame, most: int = MOST_CLUES) -> DataFrame:
    """serial_id, group_id, clue_id, label, weight, sources (snake ids), chunk_ids of each group's clues. members: snake_id, serial_id, group_id, position, chunk_id."""
    c = chunks.select(F.col("id").alias("chunk_id"), "label", "weight", "fragment_id", "sentence_index")
    rows = members.join(c, "chunk_id")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        found = []
        for snake, s in group.sort_values(["snake_id", "position"]).groupby("snake_id"):
            places = list(zip(zip(s.fragment_id, s.sentence_index, strict=True), s.chunk_id, strict=True))
            found.append({"id": int(snake), "label": f"{s.label.iloc[0]} -> {s.label.iloc[-1]}", "weight": float(s.weight.sum()), "fragments": set(s.fragment_id), "chunks": places, "sources": [int(snake)]})
        out = merge_clues(found, most)
        return pd.DataFrame([(int(group.serial_id.iloc[0]), int(group.group_id.iloc[0]), x["id"], x["label"], x["weight"], x["sources"], [int(i) for _, i in x["chunks"]]) for x in out], columns=["serial_id", "group_id", "clue_id", "label", "weight", "sources", "chunk_ids"])

    return rows.groupBy("serial_id", "group_id").applyInPandas(one, "serial_id long, group_id long, clue_id long, label string, weight double, sources array<long>, chunk_ids array<long>")
