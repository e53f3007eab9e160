"""Operator 3: repeated word passages by de Bruijn compaction.

The graph is sparse: of the ``K``-word k-mers of a text only those stay that are
the smallest of some window (minimizers), so every passage of ``SPAN`` words
holds one, chosen by its own words alone. They are the nodes; the words from one
to the next are the edge between them, known by its hash. Spark counts nodes and
edges and keeps the repeated ones. Where node, edge and next node occur equally
often, all occurrences share them: a nonbranching path. Joined back to the
source coordinates, such runs compact to one span per document, and every
window inside a span is decided by the span's smallest document at once. Windows
that cross the end of a span (at branches of the graph) and whose smallest k-mer is a repeated node are verified one by one:
their hash of 96 bits, made from the words at the source coordinates, is counted
over all documents. A word goes if a window over it, or a span, also starts in a
document with a smaller doc_id.

Shape: two shuffles of the text (to its nodes and to its spans), otherwise of
rows of a few numbers, about one for 20 words. Counts are aggregated before the
shuffle and written; the joins are of two plain exchanges, which the planner can split on hot keys. A
task holds the nodes of one document, never those of a repeated passage.

Defined cases: null text is empty; a document of fewer than ``SPAN`` words, or
with a null doc_id, loses nothing (a null doc_id isn't smaller than any either);
repeats within one doc_id don't count; rows that share a doc_id are told apart by
their text; an empty table gives an empty result; columns besides doc_id and text
are ignored by the query and kept by ``remove``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, cut_alone, map_arrow, packed, table, text_key, unpacked

SPAN, K = 50, 10
_U = np.uint64
_W = SPAN - K + 1
_TOP = np.uint32(2**32 - 1)


def _words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over the words' hashes of the block, and per row its first word."""
    s, e, first = kernel.word_bounds(raw, at)
    return kernel.prefix(kernel.word_hashes(raw, s, e)), first


def _kmers(sums: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k-mer at every word, and the positions of the nodes."""
    n = len(sums) - 1
    begin = np.arange(n)
    key = kernel.mix(kernel.range_hash(sums, begin, np.minimum(begin + K, n)))
    return key, kernel.minimizers(key, first, K, SPAN)


def nodes(docs: DataFrame) -> DataFrame:
    """doc_id, tk, pos (in words), h (the k-mer) and e (the edge to the next node; null for the last of a document)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, first = _words(raw, at)
            key, pos = _kmers(sums, first)
            if not len(pos):
                continue
            row = kernel.row_of(first, pos)
            nxt = np.minimum(np.arange(len(pos)) + 1, len(pos) - 1)
            last = (row[nxt] != row) | (nxt == np.arange(len(pos)))
            end = np.where(last, pos, pos[nxt] + K)
            edge = kernel.mix(kernel.range_hash(sums, pos, end) + (end - pos).astype(_U)).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), rows.column("tk").take(pa.array(row)), pa.array((pos - first[row]).astype(np.int32)), kernel.signed(key[pos]), pa.array(edge, mask=last)], ["doc_id", "tk", "pos", "h", "e"])

    return map_arrow(_keyed(docs), run, "doc_id long, tk long, pos int, h long, e long")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text").where("doc_id is not null")


def _runs(pos: np.ndarray, n: np.ndarray, en: np.ndarray) -> np.ndarray:
    """Number of the nonbranching run that each node belongs to."""
    go_on = (en[:-1] == n[:-1]) & (n[:-1] == n[1:])
    return np.concatenate(([0], np.cumsum(~go_on)))


def spans_and_windows(graph: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, tk, start, stop, and for a window that isn't decided yet its hash (h, c); a span that is decided has none.

    graph: per document its repeated nodes, sorted: arrays of pos, n (occurrences), lo (smallest doc_id), en (occurrences of the edge to the next).
    """

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            sums, first = _words(raw, at)
            key, every = _kmers(sums, first)
            bounds = np.searchsorted(every, first)
            # a second hash, of other symbols, makes the windows' fingerprint 96 bits long
            other = kernel.prefix(kernel.mix(np.diff(sums) * kernel.powers(len(sums))[1][: len(sums) - 1] + _U(0x5851F42D4C957F2D))) if len(sums) > 1 else sums
            out: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
            for r, (doc_id, g) in enumerate(zip(rows.column("doc_id").to_pylist(), rows.column("g"), strict=True)):
                g = g.values
                pos, n, lo, en = (g.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "n", "lo", "en"))
                run_of = _runs(pos, n, en)
                begins = np.flatnonzero(np.diff(run_of, prepend=-1))
                ends = np.append(begins[1:], len(pos)) - 1
                s, e = pos[begins].astype(np.int64), pos[ends].astype(np.int64) + K
                take = (e - s >= SPAN) & (lo[begins] < doc_id)
                if take.any():
                    out.append((r, s[take], e[take], None))
                all_pos = every[bounds[r] : bounds[r + 1]] - first[r]
                where = np.searchsorted(all_pos, pos)
                total = int(first[r + 1] - first[r])
                start = np.arange(total - SPAN + 1)
                run_all = np.full(len(all_pos), -1)
                run_all[where] = run_of
                # a window can only be repeated if its smallest k-mer, which is a node wherever the window occurs, is a repeated node
                small = np.append((key[every[bounds[r] : bounds[r + 1]]] >> _U(33)).astype(np.uint32), _TOP)
                ours = np.where(np.append(run_all, -1) >= 0, small, _TOP)
                a, b = np.searchsorted(all_pos, start), np.searchsorted(all_pos, start + _W) - 1  # first and last node within the window
                ranges = np.column_stack((a, b + 1)).ravel()
                open_ = np.minimum.reduceat(small, ranges)[::2] == np.minimum.reduceat(ours, ranges)[::2]
                ra, rb = run_all[a], run_all[b]
                inside = (ra == rb) & (ra >= 0) & (start >= s[ra]) & (start + SPAN <= e[ra])
                start = start[open_ & ~inside]
                if len(start):
                    out.append((r, start, start + SPAN, first[r] + start))
            if not out:
                continue
            row = np.concatenate([np.full(len(x[1]), x[0]) for x in out])
            begin, stop = (np.concatenate([x[k] for x in out]) for k in (1, 2))
            decided = np.concatenate([np.full(len(x[1]), x[3] is None) for x in out])
            p = np.concatenate([np.zeros(len(x[1]), np.int64) if x[3] is None else x[3] for x in out])
            h = kernel.mix(kernel.range_hash(sums, p, p + np.where(decided, 0, SPAN)))
            c = (kernel.mix(kernel.range_hash(other, p, p + np.where(decided, 0, SPAN))) >> _U(33)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(row)), rows.column("tk").take(pa.array(row)), pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(h.view(np.int64), mask=decided), pa.array(c, mask=decided)], ["doc_id", "tk", "start", "stop", "h", "c"])

    texts = _keyed(docs).withColumnsRenamed({"doc_id": "t_id", "tk": "t_key"})
    both = graph.join(texts, (F.col("doc_id") == F.col("t_id")) & (F.col("tk") == F.col("t_key"))).select("doc_id", "tk", "text", "g")
    return map_arrow(both, run, "doc_id long, tk long, start int, stop int, h long, c int")


def repeated_graph(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, tk) its nodes that occur in several documents, with counts; one row for each document that has any."""
    found = cut(nodes(docs).dropDuplicates(["doc_id", "tk", "pos"]) if _repeats(docs) else nodes(docs), "nodes")
    # counts are written before they are joined: only a join of two plain exchanges is split by the planner at a node that very many documents hold
    often = cut(found.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "n", "lo"), "repeated")
    kept = cut(found.join(often, "h").select("doc_id", "tk", "pos", "n", "lo", "e"), "repeated-nodes")
    edges = cut(kept.where("e is not null").groupBy("e").agg(F.count("*").alias("en")).where("en > 1"), "edges")
    joined = kept.join(edges, "e", "left").select("doc_id", "tk", F.struct("pos", "n", "lo", F.coalesce("en", F.lit(0)).alias("en")).alias("x"))
    return joined.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list("x")).alias("g"))


def _repeats(docs: DataFrame) -> bool:
    """Whether any row occurs twice (same doc_id); only then its nodes must be counted once."""
    return docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count() > 0


def repeated_spans(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, tk) the word spans to remove: spans, an array of (start, stop), overlapping and unsorted."""
    twice = _repeats(docs)
    pieces = cut_alone(lambda: spans_and_windows(repeated_graph(docs), docs).distinct() if twice else spans_and_windows(repeated_graph(docs), docs), "spans")
    windows = pieces.where("h is not null")
    least = cut(windows.groupBy("h", "c").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "c", "lo"), "repeated-windows")
    hit = windows.join(least, ["h", "c"]).where("doc_id > lo")
    every = pieces.where("h is null").select("doc_id", "tk", "start", "stop").unionByName(hit.select("doc_id", "tk", "start", "stop"))
    return every.groupBy("doc_id", "tk").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def with_spans(docs: DataFrame) -> DataFrame:
    """``docs`` with sub_spans (null: nothing to remove)."""
    spans = repeated_spans(docs.select("doc_id", "text")).withColumnsRenamed({"doc_id": "s_id", "tk": "s_key", "spans": "sub_spans"})
    keyed = packed(docs, doc_id=docs["doc_id"], sub_key=text_key(docs["text"]))
    return unpacked(keyed.join(spans, (F.col("doc_id") == F.col("s_id")) & (F.col("sub_key") == F.col("s_key")), "left"), docs, "sub_spans")


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = (text or "").encode().split()
    if not spans:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, [x["start"] for x in spans], 1)
    np.add.at(gone, [x["stop"] for x in spans], -1)
    return [w for w, g in zip(words, np.cumsum(gone), strict=False) if not g], len(words)


def remove(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages taken out; a changed text is its kept words joined by one space."""
    def cleaned(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([x if y is None else b" ".join(kept_words(x, list(y))[0]).decode() for x, y in zip(text, spans, strict=True)])

    marked = with_spans(packed(docs, doc_id=docs["doc_id"], text=docs["text"]))
    text = F.when(F.col("sub_spans").isNull(), F.col("text")).otherwise(F.pandas_udf(cleaned, "string")("text", "sub_spans"))
    return unpacked(marked.withColumn("row", F.col("row").withField("text", text)), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        n_words, removed, sha = [], [], []
        for text, spans in zip(batch.column("text"), batch.column("sub_spans").to_pylist(), strict=True):
            kept, n = kept_words(text.as_py(), spans)
            n_words.append(n)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    marked = with_spans(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "sub_spans")
    return map_arrow(marked, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = r"""
with d as materialized (select row_number() over () rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
g as materialized (select rid, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) h from (select rid, doc_id, w, unnest(range(1, len(w) - 48)) i from d where len(w) >= 50)),
f as (select h, min(doc_id) lo from g group by h having min(doc_id) < max(doc_id)),
hit as (select rid, unnest(range(i, i + 50)) p from g join f using (h) where doc_id > lo),
gone as (select distinct rid, p from hit),
x as (select rid, doc_id, unnest(w) word, unnest(range(1, len(w) + 1)) p from d),
k as (select rid, count(*) n, string_agg(word, ' ' order by p) t from x anti join gone using (rid, p) group by rid)
select doc_id, len(w)::bigint n_words, (len(w) - coalesce(n, 0))::bigint n_removed, sha256(coalesce(t, '')) kept_sha256 from d left join k using (rid)"""
