"""Operator 9: repeated byte strings by a hash-compared suffix sort.

Every string of ``SPAN`` bytes holds an anchor: a ``K``-byte string that is the
smallest of some window (a minimizer), so it is found at the same place wherever
the string occurs. Around each anchor lies its context, the bytes that a string
of ``SPAN`` bytes over the anchor can reach. Spark counts anchors together with
the hash of their context: a context that occurs twice is repeated as a whole and
needs no more. What is left (anchors that occur in several contexts, some of them
only once) goes to a suffix sort: contexts of one anchor meet in a bucket, the
suffixes from the anchor on, and the reversed prefixes before it, are sorted by a
mergesort that compares two suffixes by prefix polynomial hashes and a binary
search for their common extension. The extensions of neighbours give, for every
offset of a string over the anchor, which contexts share it. Common extensions of
neighbours are verified byte by byte; a bucket with a hash collision is sorted by
its bytes instead. A byte goes if some string over it starts anywhere else too.

A passage of many words can be shorter than ``SPAN`` bytes. Such are not removed, but the
query reports them: n_passages is n_spans, or where that is 0 the number of different
windows of ``WORDS`` words that another document holds as well.

Shape: two shuffles of the text, otherwise rows of a few numbers (about one for
170 bytes) and, for the sort, one copy of each distinct context. Counts are
aggregated before the shuffle, so copies of a document add no contexts. An anchor
with more than ``HOT`` contexts is dealt into buckets by what its strings share
beyond the anchor (``PARTS`` ranges of offsets, keyed by the bytes common to all
strings of the range), so no string is lost and a bucket stays small.

Defined cases: null text is empty; texts shorter than ``SPAN`` bytes lose nothing;
rows that share a doc_id are different places if their texts differ, and repeated
rows (same doc_id and text) are copies of each other as any others are; a null
doc_id is a document like others; an empty table gives an empty result; columns
besides doc_id and text are ignored by the query and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, cut_alone, map_arrow, packed, small_batches, table, text_key, tidy, unpacked

SPAN, K = 400, 64
HOT, PARTS = 20_000, 8
#: Contexts that are sorted at a time, whole buckets at least.
ROWS = 1024
#: Contexts times offsets that are held against each other at once.
CELLS = 1 << 17
_REACH = SPAN - K
#: Passages that are reported, not removed: windows of WORDS words that another document holds, found by their smallest WORD_K-word k-mer.
WORDS, WORD_K = 50, 10
_U = np.uint64


def _anchors(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix sums, the k-mer hashes at the anchors, and the anchors' positions."""
    sums = kernel.byte_prefix(raw)
    n = len(raw)
    begin = np.arange(n)
    key = kernel.mix(kernel.range_hash(sums, begin, np.minimum(begin + K, n)))
    pos = kernel.minimizers(key, at, K, SPAN)
    return sums, key[pos], pos


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, tk, pos (bytes), h (the anchor), x (its context and where the anchor lies in it), l, r (bytes of context before and from the anchor on)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, key, pos = _anchors(raw, at)
            if not len(pos):
                continue
            row = kernel.row_of(at, pos)
            left, right = np.minimum(pos - at[row], _REACH), np.minimum(at[row + 1] - pos, SPAN)
            x = kernel.mix(kernel.range_hash(sums, pos - left, pos + right) + (left * 1009 + right).astype(_U))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), rows.column("tk").take(pa.array(row)), pa.array((pos - at[row]).astype(np.int32)), kernel.signed(key), kernel.signed(x), pa.array(left.astype(np.int16)), pa.array(right.astype(np.int16))], ["doc_id", "tk", "pos", "h", "x", "l", "r"])

    return map_arrow(_keyed(docs), run, "doc_id long, tk long, pos int, h long, x long, l short, r short")


def contexts(wanted: DataFrame, docs: DataFrame) -> DataFrame:
    """The bytes around the wanted anchors: bucket, doc_id, tk, pos, n, l, ctx. wanted: per document an array of (pos, h, n, hot)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, data = None, raw.tobytes()
            for k in range(rows.num_rows):
                g = rows.column("g")[k].values
                pos, h, n, hot = (g.field(name).to_numpy(zero_copy_only=False) for name in ("pos", "h", "n", "hot"))
                p = at[k] + pos.astype(np.int64)
                a, b = np.maximum(p - _REACH, at[k]), np.minimum(p + SPAN, at[k + 1])
                which, bucket = [np.flatnonzero(~hot)], [h[~hot]]
                if hot.any():
                    sums = kernel.byte_prefix(raw) if sums is None else sums
                    step = -(-(_REACH + 1) // PARTS)
                    for part in range(PARTS):  # strings that begin from part * step to part * step + step - 1 bytes before the anchor all hold [s, e)
                        s, e = p - part * step, p - min(part * step + step - 1, _REACH) + SPAN
                        fits = np.flatnonzero(hot & (s >= at[k]) & (e <= at[k + 1]))
                        which.append(fits)
                        bucket.append(kernel.mix(kernel.range_hash(sums, s[fits], e[fits]) + _U(part + 1)).view(np.int64))
                i = np.concatenate(which)
                if len(i):
                    same = pa.array(np.full(len(i), k))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(bucket)), rows.column("doc_id").take(same), rows.column("tk").take(same), pa.array(pos[i]), pa.array(n[i]), pa.array((p - a)[i].astype(np.int32)), pa.array([data[a[j] : b[j]] for j in i], pa.binary())], ["bucket", "doc_id", "tk", "pos", "n", "l", "ctx"])

    texts = _keyed(docs).withColumnsRenamed({"doc_id": "t_id", "tk": "t_key"}).dropDuplicates(["t_id", "t_key"]) if _repeats(docs) else _keyed(docs).withColumnsRenamed({"doc_id": "t_id", "tk": "t_key"})
    both = wanted.join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("tk") == F.col("t_key"))).select("doc_id", "tk", "text", "g")
    return map_arrow(both, run, "bucket long, doc_id long, tk long, pos int, n long, l int, ctx binary")


def _repeats(docs: DataFrame) -> bool:
    return docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


class Suffixes:
    """Suffixes [start + offset, end) of the contexts [start, end) that follow each other in a byte buffer, compared through prefix polynomial hashes.

    The powers begin again with every context, so a table as long as one context serves them all, and the sums are made piece by piece.
    """

    def __init__(self, data: bytes, start: np.ndarray, end: np.ndarray, offset: np.ndarray):
        self.data, self.begin, self.end = data, start + offset, end
        self.raw = np.frombuffer(data, np.uint8)
        power, inverse = kernel.powers(int((end - start).max(initial=0)) + 1)
        self.back = inverse[offset]
        self.sums = np.zeros(len(self.raw) + 1, _U)
        order = np.argsort(start)
        for k in range(0, len(order), 1024):
            some = order[k : k + 1024]
            a, b = int(start[some[0]]), int(end[some[-1]])
            size = (end - start)[some]
            place = np.arange(b - a) - np.repeat(np.cumsum(size) - size, size)
            np.cumsum(kernel.symbols(self.raw[a:b]) * power[place], dtype=_U, out=self.sums[a + 1 : b + 1])
            self.sums[a + 1 : b + 1] += self.sums[a]

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes x and y, by binary search over hashes of equal length."""
        bx, by = self.begin[x], self.begin[y]
        lo, hi = np.zeros(len(x), np.int64), np.minimum(self.end[x] - bx, self.end[y] - by)
        todo = np.flatnonzero(lo < hi)
        while len(todo):
            mid = (lo[todo] + hi[todo] + 1) >> 1
            p, q = bx[todo], by[todo]
            same = (self.sums[p + mid] - self.sums[p]) * self.back[x[todo]] == (self.sums[q + mid] - self.sums[q]) * self.back[y[todo]]
            lo[todo], hi[todo] = np.where(same, mid, lo[todo]), np.where(same, hi[todo], mid - 1)
            todo = todo[lo[todo] < hi[todo]]
        return lo

    def compare(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix x is smaller than, equal to or larger than y."""
        n = self.common(x, y)
        dx, dy = self.end[x] - self.begin[x] == n, self.end[y] - self.begin[y] == n
        cx = self.raw[np.where(dx, 0, self.begin[x] + n)].astype(np.int16)
        cy = self.raw[np.where(dy, 0, self.begin[y] + n)].astype(np.int16)
        return np.sign(np.where(dx, -1, cx) - np.where(dy, -1, cy))

    def sort(self, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mergesort of every bucket (suffixes first[b] to first[b + 1] - 1): the order, and the common extension with the one before (0 for a bucket's first)."""
        n = int(first[-1])
        order, size = np.arange(n), np.repeat(np.diff(first), np.diff(first))
        base = np.repeat(first[:-1], np.diff(first))
        width, most = 1, int(size.max(initial=0))
        while width < most:
            at = np.flatnonzero(size > width)
            local = at - base[at]
            block = base[at] + local // (2 * width) * (2 * width)
            stop = np.minimum(block + 2 * width, base[at] + size[at])
            half = np.minimum(block + width, stop)
            in_left = local % (2 * width) < width
            lo, hi = np.where(in_left, half, block), np.where(in_left, stop, half)
            from_ = lo.copy()
            todo = np.flatnonzero(lo < hi)
            while len(todo):  # the rank of every suffix in the other half of its block
                mid = (lo[todo] + hi[todo]) >> 1
                c = self.compare(order[mid], order[at[todo]])
                on = np.where(in_left[todo], c < 0, c <= 0)
                lo[todo], hi[todo] = np.where(on, mid + 1, lo[todo]), np.where(on, hi[todo], mid)
                todo = todo[lo[todo] < hi[todo]]
            new = order.copy()
            new[np.where(in_left, at, block + at - half) + lo - from_] = order[at]
            order, width = new, 2 * width
        shared = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[first[:-1][np.diff(first) > 0]] = False
        inner = np.flatnonzero(inner)
        shared[inner] = self.common(order[inner], order[inner - 1])
        self._verify(first, order, shared, inner)
        return order, shared

    def _text(self, x: int) -> bytes:
        return self.data[self.begin[x] : self.end[x]]

    def _verify(self, first, order, shared, inner) -> None:
        """Neighbours must agree in exactly their common extension and be in order; else the bucket is sorted by its bytes."""
        wrong = set()
        for i, x, y, n in zip(inner.tolist(), order[inner - 1].tolist(), order[inner].tolist(), shared[inner].tolist(), strict=True):
            a, b = self._text(x), self._text(y)
            if a[:n] != b[:n] or a[n : n + 1] > b[n : n + 1] or (n < len(a) and a[n : n + 1] == b[n : n + 1]):
                wrong.add(int(np.searchsorted(first, i, "right")) - 1)
        for b in wrong:
            s, e = int(first[b]), int(first[b + 1])
            order[s:e] = sorted(range(s, e), key=self._text)
            for i in range(s + 1, e):
                shared[i] = len(os.path.commonprefix([self._text(order[i - 1]), self._text(order[i])]))


def reach(rank_r: np.ndarray, shared_r: np.ndarray, rank_l: np.ndarray, shared_l: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """For the contexts of one bucket the largest and smallest offset (bytes before the anchor) of a shared string; -1: none.

    rank: place of each context in the order of suffixes (r) and of reversed prefixes (l); shared: common extension with the one before in that order.
    Two contexts share the string of offset o if they agree in o bytes to the left and span - o from the anchor on, that is, fall in one class of either order.
    """
    m = len(rank_r)
    far, near = np.full(m, -1), np.full(m, -1)
    offsets = np.unique(np.concatenate((shared_l[1:], span - shared_r[1:])))  # only at these the classes change
    offsets = offsets[(offsets >= 0) & (offsets <= span)]
    step = max(1, CELLS // m)
    for k in range(0, len(offsets), step):
        some = offsets[k : k + step, None]
        left, right = np.zeros((len(some), m), np.int64), np.zeros((len(some), m), np.int64)
        np.cumsum(shared_l[None, 1:] < some, axis=1, out=left[:, 1:])
        np.cumsum(shared_r[None, 1:] < span - some, axis=1, out=right[:, 1:])
        key = left[:, rank_l] * m + right[:, rank_r]
        order = np.argsort(key, axis=1)
        ranked = np.take_along_axis(key, order, axis=1)
        same = ranked[:, 1:] == ranked[:, :-1]
        both = np.zeros((len(some), m), bool)
        both[:, 1:] = same
        both[:, :-1] |= same
        hit = np.zeros((len(some), m), bool)
        np.put_along_axis(hit, order, both, axis=1)
        any_ = hit.any(axis=0)
        last = len(some) - 1 - hit[::-1].argmax(axis=0)
        far[any_] = some[last[any_], 0]
        new = any_ & (near < 0)
        near[new] = some[hit.argmax(axis=0)[new], 0]
    return far, near


def shared_strings(table_: DataFrame) -> DataFrame:
    """doc_id, tk, start, stop of what contexts of one bucket share, for contexts that occur once (n = 1)."""

    def solve(chunk: pa.Table) -> pa.RecordBatch | None:
        bucket = chunk.column("bucket").to_numpy()
        first = np.concatenate(([0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]))
        ctx, left, n = chunk.column("ctx").to_pylist(), chunk.column("l").to_numpy().astype(np.int64), chunk.column("n").to_numpy()
        size = np.array(list(map(len, ctx)), np.int64)
        data, at = b"".join(ctx), np.cumsum(size) - size
        del ctx
        m = np.diff(first)
        order_r, shared_r = Suffixes(data, at, at + size, left).sort(first)
        back = len(data) - at  # the bytes before the anchor, read backwards
        order_l, shared_l = Suffixes(data[::-1], back - size, back, size - left).sort(first)
        rank_r, rank_l = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        rank_r[order_r] = rank_l[order_l] = np.arange(len(n))
        far, near = np.full(len(n), -1), np.full(len(n), -1)
        two = first[:-1][m == 2]
        o, r = shared_l[two + 1], shared_r[two + 1]
        good = o + r >= SPAN
        for k in (0, 1):
            far[two + k], near[two + k] = np.where(good, o, -1), np.where(good, SPAN - r, -1)
        for b in np.flatnonzero(m > 2):
            s, e = first[b], first[b + 1]
            far[s:e], near[s:e] = reach(rank_r[s:e] - s, shared_r[s:e], rank_l[s:e] - s, shared_l[s:e])
        hit = np.flatnonzero((far >= 0) & (near >= 0) & (n == 1))
        if not len(hit):
            return None
        pos = chunk.column("pos").to_numpy().astype(np.int64)[hit]
        some = chunk.select(["doc_id", "tk"]).take(pa.array(hit)).combine_chunks()
        return pa.RecordBatch.from_arrays([some.column(0).chunk(0), some.column(1).chunk(0), pa.array((pos - far[hit]).astype(np.int32)), pa.array((pos - near[hit] + SPAN).astype(np.int32))], ["doc_id", "tk", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            key = batch.column("bucket").to_numpy()
            other = np.flatnonzero(key != key[-1])
            whole = int(other[-1]) + 1 if len(other) else 0  # rows before the last bucket, which may go on in the next batch
            if rows + whole >= ROWS and (whole or last != key[0]):
                done = solve(pa.Table.from_batches([*held, batch.slice(0, whole)]))
                held, rows, batch = [], 0, batch.slice(whole)
                if done:
                    yield done
            held.append(batch)
            rows += batch.num_rows
            last = key[-1]
        if held:
            done = solve(pa.Table.from_batches(held))
            if done:
                yield done
        tidy()

    small_batches(table_.sparkSession)
    return table_.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "doc_id long, tk long, start int, stop int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, tk) the byte spans to remove: spans, an array of (start, stop), overlapping and unsorted."""
    found = cut(anchors(docs), "anchors")
    place = F.min(F.struct("doc_id", "tk", "pos", "l", "r")).alias("place")
    per = cut(found.groupBy("h", "x").agg(F.count("*").alias("n"), place), "contexts")
    whole = per.where("n > 1 and place.l + place.r >= " + str(SPAN)).select(F.col("h").alias("wh"), F.col("x").alias("wx"))
    covered = found.join(whole, (F.col("h") == F.col("wh")) & (F.col("x") == F.col("wx"))).select("doc_id", "tk", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("r")).alias("stop"))
    mixed = cut(per.groupBy("h").agg(F.count("*").alias("nx"), F.min("n").alias("least")).where("nx > 1 and least = 1").select("h", (F.col("nx") > HOT).alias("hot")), "mixed")
    wanted = per.join(mixed, "h").where(f"place.l + place.r >= {SPAN}").select("place.doc_id", "place.tk", F.struct("place.pos", "h", "n", "hot").alias("y")).groupBy("doc_id", "tk").agg(F.collect_list("y").alias("g"))
    sorted_ = shared_strings(contexts(wanted, docs))
    both = cut(covered.unionByName(sorted_), "byte-spans")
    return both.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with suf_spans (null: nothing to remove)."""
    spans = repeated_spans(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "s_id", "tk": "s_key", "spans": "suf_spans"})
    keyed = packed(docs, doc_id=docs["doc_id"], suf_key=text_key(docs["text"]))
    return unpacked(keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("suf_key") == F.col("s_key")), "left"), docs, "suf_spans")


def kept_bytes(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """The bytes that stay, how many go, and in how many runs."""
    out, at, gone, runs = [], 0, 0, 0
    last = -1
    for s, e in sorted((x["start"], x["stop"]) for x in spans or ()):
        runs += s > last
        if s > at:
            out.append(data[at:s])
        gone += max(0, e - max(s, at))
        at, last = max(at, e), max(last, e)
    out.append(data[at:])
    return b"".join(out), gone, runs


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated strings taken out; bytes of a character that was cut through go too."""
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else kept_bytes(x.encode(), list(y))[0].decode("utf-8", "ignore") for x, y in zip(text, spans, strict=True)])

    marked = with_spans(packed(docs, doc_id=docs["doc_id"], text=docs["text"]))
    text = F.when(F.col("suf_spans").isNull(), F.col("text")).otherwise(F.pandas_udf(cleaned, "string")("text", "suf_spans"))
    return unpacked(marked.withColumn("row", F.col("row").withField("text", text)), docs)


def shared_passages(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, tk, windows: how many different windows of ``WORDS`` words another document holds as well, for the documents without ``spans`` that have any.

    A passage of that many words may be shorter than ``SPAN`` bytes, so the suffix sort needn't see it. Of the k-mers that are the smallest of a window,
    those that several documents hold are looked for in the documents without spans; windows whose smallest k-mer is one of these are counted by a hash of 128 bits.
    """
    keyed = _keyed(docs)

    def places(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, first = _word_sums(raw, at)
            key, pos = _word_anchors(sums, first)
            row, h = kernel.row_of(first, pos), key[pos]
            order = np.lexsort((h, row))
            row, h = row[order], h[order]
            one = np.ones(len(h), bool)
            one[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
            at_ = pa.array(row[one])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(at_), rows.column("tk").take(at_), kernel.signed(h[one])], ["doc_id", "tk", "h"])

    def windows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, first = _word_sums(raw, at)
            key, pos = _word_anchors(sums, first)
            other = kernel.prefix(kernel.mix(np.diff(sums) * kernel.powers(len(sums))[1][: len(sums) - 1] + _U(0x5851F42D4C957F2D)))
            small = key >> _U(33)
            for k in range(rows.num_rows):
                mine = pos[np.searchsorted(pos, first[k]) : np.searchsorted(pos, first[k + 1])]
                asked = mine[np.isin(key[mine].view(np.int64), rows.column("g")[k].values.to_numpy())]
                starts = (asked[:, None] - np.arange(WORDS - WORD_K + 1)[None, :]).ravel()
                node = np.repeat(asked, WORDS - WORD_K + 1)
                fits = (starts >= first[k]) & (starts + WORDS <= first[k + 1])
                starts, node = starts[fits], node[fits]
                if not len(starts):
                    continue
                # the window's smallest k-mer must be the one asked for
                lo, hi = np.searchsorted(mine, starts), np.searchsorted(mine, starts + (WORDS - WORD_K + 1))
                least = np.minimum.reduceat(np.append(small[mine], _U(2**40)), np.column_stack((lo, hi)).ravel())[::2]
                starts = np.unique(starts[least == small[node]])
                a, b = (kernel.mix(kernel.range_hash(x, starts, starts + WORDS)) for x in (sums, other))
                _, keep = np.unique(a, return_index=True)
                same = pa.array(np.full(len(keep), k))
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(same), rows.column("tk").take(same), rows.column("open").take(same), kernel.signed(a[keep]), kernel.signed(b[keep])], ["doc_id", "tk", "open", "a", "b"])

    def several(rows: DataFrame, *by: str) -> DataFrame:
        place = F.struct("doc_id", "tk")
        return rows.groupBy(*by).agg(F.min(place).alias("lo"), F.max(place).alias("hi")).where(~F.col("lo").eqNullSafe(F.col("hi"))).select(*[F.col(x).alias(f"s_{x}") for x in by])

    found = cut(map_arrow(keyed, places, "doc_id long, tk long, h long"), "word-anchors")
    covered = spans.select(F.col("doc_id").alias("c_id"), F.col("tk").alias("c_key"))
    asked = found.join(cut(several(found, "h"), "shared-anchors"), F.col("h") == F.col("s_h"))
    asked = cut(asked.join(covered, F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("tk") == F.col("c_key")), "left").select("doc_id", "tk", "h", F.col("c_key").isNull().alias("open")), "asked-anchors")
    wanted = cut(asked.where("open").select(F.col("h").alias("w_h")).distinct(), "wanted-anchors")
    per = asked.join(wanted, F.col("h") == F.col("w_h")).groupBy("doc_id", "tk").agg(F.collect_set("h").alias("g"), F.first("open").alias("open")).withColumnsRenamed({"doc_id": "g_id", "tk": "g_key"})
    both = keyed.join(per, F.col("doc_id").eqNullSafe(F.col("g_id")) & (F.col("tk") == F.col("g_key"))).select("doc_id", "tk", "text", "g", "open")
    held = cut(map_arrow(both, windows, "doc_id long, tk long, open boolean, a long, b long"), "word-windows")
    twice = cut(several(held, "a", "b"), "shared-windows")
    hit = held.where("open").join(twice, (F.col("a") == F.col("s_a")) & (F.col("b") == F.col("s_b")))
    return hit.select("doc_id", "tk", "a", "b").distinct().groupBy("doc_id", "tk").agg(F.count("*").alias("windows"))


def _word_sums(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over the words' hashes of the block, and per row its first word."""
    s, e, first = kernel.word_bounds(raw, at)
    return kernel.prefix(kernel.word_hashes(raw, s, e)), first


def _word_anchors(sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-mer at every word, and the positions of those that are the smallest of a window."""
    n = len(sums) - 1
    begin = np.arange(n)
    key = kernel.mix(kernel.range_hash(sums, begin, np.minimum(begin + WORD_K, n)))
    return key, kernel.minimizers(key, first, WORD_K, WORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = cut_alone(lambda: repeated_spans(docs), "document-spans")
    windows = cut_alone(lambda: shared_passages(docs, spans), "document-windows")
    found = spans.join(windows.withColumnsRenamed({"doc_id": "w_id", "tk": "w_key"}), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("tk") == F.col("w_key")), "full")
    found = found.select(F.coalesce("doc_id", "w_id").alias("s_id"), F.coalesce("tk", "w_key").alias("s_key"), F.col("spans").alias("suf_spans"), "windows")
    keyed = _keyed(docs)
    marked = keyed.join(found, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("tk") == F.col("s_key")), "left").select("doc_id", "text", "suf_spans", "windows")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        out = []
        for doc_id, text, spans, windows in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("suf_spans").to_pylist(), batch.column("windows").to_pylist(), strict=True):
            data = (text.as_py() or "").encode()
            kept, gone, runs = kept_bytes(data, spans)
            out.append({"doc_id": doc_id, "n_bytes": len(data), "n_removed": gone, "n_spans": runs, "kept_sha256": hashlib.sha256(kept).hexdigest(), "n_passages": runs or windows or 0})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("n_passages", pa.int64())]))

    return map_arrow(marked, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")
