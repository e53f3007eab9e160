"""Operator 5: near-duplicates by Order MinHash.

A document is its sequence of ``K``-word shingles, each labelled with how often
it has occurred before. A sketch keeps the ``PICK`` labelled shingles of
smallest hash and puts them in text order, so it agrees for texts that share
shingles in the same order; ``SKETCHES`` sketches are made with different
hashes. Documents that agree in a sketch are candidates, and candidates are
verified by a banded alignment of their shingles: the longest common sequence
whose positions differ by no more than the similarity allows. A pair is linked
if the aligned shingles are at least ``SIMILARITY`` of all shingles of the two
(aligned / (n + m - aligned), a Jaccard similarity that heeds the order). Edits link, a
copy whose parts have changed places doesn't: that is what this method is for. Classes are the
connected components of the links.

Shape: exact copies fall together by the digest of their text before anything
else, with one representative. Candidates come in two rounds. First every member
of a sketch's bucket is held against the bucket's most central document (the one
in the largest buckets, as the original of many copies is); that links groups of
copies of any size with as many pairs as members. Then only buckets that still
hold several classes are taken, and only members of different classes are held
against each other. Buckets of up to ``SMALL`` members give their pairs as rows,
at most SMALL / 2 for each member. Larger ones, where many texts are almost
similar enough, go as blocks of at most ``BLOCK`` members, two at a time, to workers
that return only links; there a bound on what can be aligned leaves out most pairs before
any is aligned. No pair that could be a link is left out.

Defined cases: null text is empty; a document without words is alone in its
class; one of fewer than ``K`` words has one shingle, all its words; rows with a
null doc_id get class null; rows that share a doc_id and a text are one document, and rows
that share a doc_id only are joined in one class by it;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .common import cut, map_arrow, packed, small_batches, table, tidy, unpacked
from .components import components

K, SIMILARITY = 5, 0.8
#: At similarity 0.8 a sketch of 5 agrees with probability 0.8**5 = 0.33, so none of 32 does with probability 3e-6.
PICK, SKETCHES = 5, 32
#: Documents of at most SHORT shingles also get sketches of one shingle: few shingles agree in five too seldom (four of five never do).
SHORT, SHORT_SKETCHES = 20, 10
SMALL, BLOCK = 30, 500
_U = np.uint64
_SEEDS = np.random.default_rng(7).integers(1, 2**63, SKETCHES, dtype=np.uint64) * _U(2) + _U(1)


def shingles(raw: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all rows, and per row its first (rows + 1). A row of fewer than k words has one, of all its words."""
    s, e, first = kernel.word_bounds(raw, at)
    sums = kernel.prefix(kernel.word_hashes(raw, s, e))
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    start = np.concatenate(([0], np.cumsum(count)))
    begin = np.repeat(first[:-1] - start[:-1], count) + np.arange(start[-1])
    end = begin + np.repeat(np.minimum(n, k), count)
    return kernel.mix(kernel.range_hash(sums, begin, end) + (end - begin).astype(_U)), start


def labelled(x: np.ndarray) -> np.ndarray:
    """Each hash with the number of equal ones before it mixed in."""
    order = np.argsort(x, kind="stable")
    y = x[order]
    new = np.concatenate(([True], y[1:] != y[:-1]))
    if new.all():
        return x
    at = np.arange(len(x))
    nth = np.empty(len(x), _U)
    nth[order] = (at - np.maximum.accumulate(np.where(new, at, 0))).astype(_U)
    return np.where(nth > 0, kernel.mix(x + nth * _U(0x9E3779B97F4A7C15)), x)


def _lowest(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per sketch the places of the PICK shingles of smallest hash, and of the smallest of the first SHORT_SKETCHES where there are few shingles."""
    hashed = (x[None, :] ^ (x[None, :] >> _U(31))) * _SEEDS[:, None]
    few = np.argmin(hashed[:SHORT_SKETCHES], axis=1) if len(x) <= SHORT else np.zeros(0, np.int64)
    if len(x) > PICK:
        return np.argpartition(hashed, PICK - 1, axis=1)[:, :PICK], few
    return np.broadcast_to(np.arange(len(x)), (SKETCHES, len(x))), few


def _chained(picked: np.ndarray, salt: int) -> np.ndarray:
    key = np.zeros(SKETCHES, _U) + np.arange(salt, salt + SKETCHES).astype(_U)
    for j in range(picked.shape[1]):
        key = kernel.mix(key * _U(31) + picked[:, j])
    return key


def sketch(x: np.ndarray) -> np.ndarray:
    """Distinct bucket keys of one document from its shingles in text order."""
    named = labelled(x)
    low, few = _lowest(named)
    return np.unique(np.concatenate((_chained(named[np.sort(low, axis=1)], 0), kernel.mix(named[few] + np.arange(1000, 1000 + len(few)).astype(_U)))))


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text) and keys (empty without words)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for rows, raw, at in kernel.blocks(batch):
            x, start = shingles(raw, at)
            keys = [sketch(x[a:b]).view(np.int64) if b > a else np.zeros(0, np.int64) for a, b in zip(start[:-1], start[1:], strict=True)]
            flat = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, keys)]), pa.int32()), pa.array(np.concatenate(keys)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("digest"), flat], ["doc_id", "digest", "keys"])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), "text")
    return map_arrow(rows, run, "doc_id long, digest binary, keys array<long>")


def reachable(n, m, shared) -> np.ndarray:
    """Whether texts of n and m shingles can be similar enough if at most ``shared`` can be aligned."""
    return shared >= SIMILARITY * (n + m - shared)


def aligned(la: np.ndarray, lb: np.ndarray) -> float:
    """Similarity of two documents (labelled shingles in text order) by banded alignment."""
    _, i, j = np.intersect1d(la, lb, assume_unique=True, return_indices=True)
    total = len(la) + len(lb)
    if not reachable(len(la), len(lb), len(i)):
        return len(i) / (total - len(i))
    band = total * (1 - SIMILARITY) / (1 + SIMILARITY) + 1  # more unmatched shingles than this and the pair can't reach the similarity
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    j = j[np.argsort(i)]
    chain = len(j)
    if chain > 1 and (np.diff(j) < 0).any():
        tails: list[int] = []
        for y in j.tolist():
            at = bisect_left(tails, y)
            tails[at : at + 1] = [y]
        chain = len(tails)
    return chain / (total - chain)


def _labelled_of(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    """The labelled shingles of every row."""
    out: list[np.ndarray] = []
    for _, raw, at in kernel.blocks(batch, column):
        x, start = shingles(raw, at)
        out += [labelled(x[p:q]) if q > p else x[p:q] for p, q in zip(start[:-1], start[1:], strict=True)]
    return out


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts (doc_id, text) are similar enough."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for first in range(0, batch.num_rows, 512):
            some = batch.slice(first, 512)
            good = [aligned(x, y) >= SIMILARITY for x, y in zip(_labelled_of(some, "text_a"), _labelled_of(some, "text_b"), strict=True)]
            yield some.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    return map_arrow(pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b"), run, "a long, b long")


def shingles_of(reps: DataFrame, texts: DataFrame) -> DataFrame:
    """rep, x: the labelled shingles of the asked documents, made once however many blocks they go to."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _labelled_of(batch, "text")
        at = pa.array(np.cumsum([0, *map(len, x)]), pa.int32())
        flat = pa.array((np.concatenate(x) if x else np.zeros(0, _U)).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("rep"), pa.ListArray.from_arrays(at, flat)], ["rep", "x"])

    return map_arrow(reps.join(texts.withColumnRenamed("doc_id", "rep"), "rep"), run, "rep long, x array<long>")


def links_within(members: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between members of different classes of large buckets: rows key, rep, n, class. A pair is tried in the large bucket of the smallest key that both share."""
    keys = members.groupBy("rep").agg(F.sort_array(F.collect_set("key")).alias("large"))
    whole = cut(shingles_of(members.select("rep").distinct(), texts).join(keys, "rep"), "large-shingles")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = members.select("key", "rep", "class", mine.alias("mine"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("rep", "class", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, []
        for batch in batches:
            heads = [batch.column(c).to_pylist() for c in ("key", "i", "j", "mine", "rep", "class")]
            large, x = batch.column("large"), batch.column("x")
            for k, (key, i, j, *rest) in enumerate(zip(*heads, strict=True)):
                if (key, i, j) != now:
                    yield from tried(now, group)
                    now, group = (key, i, j), []
                group.append((*rest, x[k].values.to_numpy().copy(), large[k].values.to_numpy().copy()))
        yield from tried(now, group)
        tidy()

    small_batches(members.sparkSession)
    rows = dealt.join(whole, "rep").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "rep")
    return rows.select("key", "i", "j", "mine", "rep", "class", "x", "large").mapInArrow(run, "a long, b long").distinct()


def tried(group_of: tuple | None, group: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of links between the members (block, rep, class, shingles, large keys) of one or two blocks of a bucket.

    A shingle that no other member holds can't be aligned, which leaves most pairs of texts that are almost similar enough out before any is aligned.
    """
    if len(group) < 2:
        return
    key, i, j = group_of
    block, reps, own = (np.array([m[k] for m in group]) for k in range(3))
    sharing = defaultdict(list)
    for k, m in enumerate(group):
        for x in m[4][m[4] < key].tolist():
            sharing[x].append(k)
    size = np.array([len(m[3]) for m in group])
    holder = np.repeat(np.arange(len(group)), size)
    _, back, often = np.unique(np.concatenate([m[3] for m in group]), return_inverse=True, return_counts=True)
    common = np.bincount(holder[often[back] > 1], minlength=len(group))
    asked = (own[:, None] != own[None, :]) & reachable(size[:, None], size[None, :], np.minimum(common[:, None], common[None, :]))
    for held in sharing.values():  # these pairs are tried there
        if len(held) > 1:
            asked[np.ix_(held, held)] = False
    asked &= (block[:, None] != block[None, :]) if i != j else True
    top = {int(c): int(c) for c in own}

    def find(c: int) -> int:
        while top[c] != c:
            top[c] = top[top[c]]
            c = top[c]
        return c

    out = []
    kind = own.tolist()
    sets: dict[int, frozenset] = {}
    for k, o in zip(*(x.tolist() for x in np.nonzero(np.triu(asked, 1))), strict=True):
        x, y = find(kind[k]), find(kind[o])
        if x == y:
            continue  # their classes are linked already
        for m in (k, o):
            if m not in sets:
                sets[m] = frozenset(group[m][3].tolist())
        if reachable(size[k], size[o], len(sets[k] & sets[o])) and aligned(group[k][3], group[o][3]) >= SIMILARITY:
            top[x] = y
            out.append((int(reps[k]), int(reps[o])))
    if out:
        yield pa.RecordBatch.from_pydict({"a": [x for x, _ in out], "b": [x for _, x in out]}, pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, digest, class_id: the smallest doc_id of the class. One row per doc_id and text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = cut(sketches(docs), "sketches")
    copies = made.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    first = made.join(copies.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & (F.col("doc_id") == F.col("rep"))).where(F.size("keys") > 0)
    first = cut(first.dropDuplicates(["digest"]).select("rep", "keys"), "representatives")
    rows = first.select("rep", F.explode("keys").alias("key"))
    # written before the join: only a join of two plain exchanges is split by the planner where a bucket is very large
    sizes = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "sizes")
    shared = cut(rows.join(sizes, "key"), "shared")
    central = cut(shared.groupBy("rep").agg(F.sum("n").alias("c")), "central")
    placed = cut(shared.join(central, "rep"), "placed")
    pivots = cut(placed.groupBy("key").agg(F.max(F.struct(F.col("c"), (-F.col("rep")).alias("r"))).alias("x")).select("key", (-F.col("x.r")).alias("pivot")), "pivots")
    known = cut(placed.join(pivots, "key").where("rep <> pivot"), "known")
    # exact copies have gone, so a representative's text is read from its row
    texts = docs.where("doc_id is not null")
    one = cut(known.select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), "star-pairs")
    star = cut(verified(one, texts).distinct(), "star-links")
    # a first guess of the classes: the most central document linked, and what that one is linked to
    hop = cut(star.join(central.select(F.col("rep").alias("a"), "c"), "a").groupBy(F.col("b").alias("rep")).agg(F.max(F.struct("c", "a")).alias("x")).select("rep", F.col("x.a").alias("class")), "hop")
    far = hop.join(hop.select(F.col("rep").alias("class"), F.col("class").alias("top")), "class", "left").select("rep", F.coalesce("top", "class").alias("class"))
    known = cut(known.drop("c", "pivot").join(far, "rep", "left").select("key", "rep", "n", F.coalesce("class", "rep").alias("class")), "classed")
    # the pivot has been held against every member; the others are left if they aren't of one class
    mixed = cut(known.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo < hi").select("key"), "mixed-keys")
    rest = cut(known.join(mixed, "key"), "mixed")
    few = rest.where(F.col("n") <= SMALL)
    x, y = few.select("key", F.col("rep").alias("a"), F.col("class").alias("ca")), few.select("key", F.col("rep").alias("b"), F.col("class").alias("cb"))
    cross = x.join(y, "key").where("ca < cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    two = cut(cross.join(one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"), "cross-pairs")
    many = cut(rest.where(F.col("n") > SMALL), "large-buckets")
    links = star.unionByName(verified(two, texts)).unionByName(links_within(many, texts))
    label = cut(components(links), "classes").withColumnRenamed("node", "rep")
    member = made.select("doc_id", "digest").distinct().join(copies, "digest")
    return member.join(label, "rep", "left").select("doc_id", "digest", F.coalesce("class", "rep").alias("class_id"))


def _blank(text):
    return ~F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")


def _keyed(docs: DataFrame) -> DataFrame:
    return packed(docs, doc_id=docs["doc_id"], digest=F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))), blank=_blank(docs["text"]))


def own_class(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with class_id (in place of a column of that name). Documents without words are alone: their digest is that of no words at all."""
    found = found.select(F.col("doc_id").alias("nd_id"), F.col("digest").alias("nd_d"), F.col("class_id").alias("nd_class"))
    out = _keyed(docs).join(found, (F.col("doc_id") == F.col("nd_id")) & (F.col("digest") == F.col("nd_d")), "left")
    return unpacked(out.withColumn("class_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("nd_class"))), docs, "class_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, the one of the smallest doc_id; rows with a null doc_id stay. Its text isn't changed, and all its columns are kept."""
    found = classes(docs).where("doc_id <> class_id").select(F.col("doc_id").alias("nd_id"), F.col("digest").alias("nd_d"))
    kept = _keyed(docs).join(found, (F.col("doc_id") == F.col("nd_id")) & (F.col("digest") == F.col("nd_d")) & ~F.col("blank"), "left_anti")
    if docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        kept = kept.where("doc_id is not null").dropDuplicates(["doc_id", "digest"]).unionByName(kept.where("doc_id is null"))
    return unpacked(kept, docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    keyed = docs.select("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), _blank(F.col("text")).alias("blank"))
    found = classes(docs).select(F.col("doc_id").alias("nd_id"), F.col("digest").alias("nd_d"), F.col("class_id").alias("nd_class"))
    out = keyed.join(found, (F.col("doc_id") == F.col("nd_id")) & (F.col("digest") == F.col("nd_d")), "left")
    return out.select("doc_id", F.when(F.col("blank"), F.col("doc_id")).otherwise(F.col("nd_class")).alias("class_id"))
