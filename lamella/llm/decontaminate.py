"""Operator 8: benchmark decontamination (DataFrame functions only).

Words are runs of characters other than ASCII that is not a letter or digit,
after A-Z became a-z. Every window of ``N`` item words is hashed; the set of
hashes is broadcast while it is within a counted bound (beyond it the join
shuffles) and every window of every training text, of all lengths that items have, is looked up
in it in one scan. Texts with
a looked-up window are then compared by the words themselves, so a hash collision never counts. A
word is hit if it lies in any occurrence of a window.

Shape: texts are scanned, not shuffled: what leaves the scan are the keys of texts with
a looked-up window, which are broadcast to the second scan and to the removal while they are
within ``FOUND_ROWS``. Bounds are counted, rows of the windows' hashes and bytes of their words,
before anything is broadcast.

Defined cases: null or wordless text has no words and is clean; an item without
words has no windows; an item of fewer than ``N`` words is one window; rows that
share a doc_id are told apart by their text; empty tables give empty or clean
results; columns besides doc_id and text (item_id and text) pass through, whatever their names, or are
ignored; ``mark`` adds bm_words and bm_items in place of columns with such a name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, packed, sized_broadcast, table, text_key, unpacked

N = 10
#: Largest number of texts with a looked-up window whose keys are broadcast, and largest number of bytes of window words that are.
FOUND_ROWS, WORD_BYTES = 500_000, 64 << 20
#: The upper-case letters that are lowered, and the characters between words.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def word_hashes(w) -> Column:
    """A hash for each word: a window's hash is made of these, so that every word is read once and not once for each window over it."""
    return F.transform(w, lambda x: F.xxhash64(x))


def windows(benchmark: DataFrame, n: int = N) -> DataFrame:
    """item_id, its window as words, the window's length and hash."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    size = F.least(F.size("w"), F.lit(n))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.slice("w", i, size))
    return items.select("item_id", F.explode(each).alias("window")).distinct().withColumn("len", F.size("window")).withColumn("h", F.xxhash64(word_hashes(F.col("window"))))


def _each(w, lengths: list[int], fn) -> Column:
    """fn(window, its place from 1) of every window of each length. The outer transform binds the words to a variable, else the optimizer splits the text again for every window."""
    def every(x: Column, n: int) -> Column:
        at = F.when(F.size(x) >= n, F.sequence(F.lit(1), F.size(x) - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: fn(F.slice(x, i, n), i))

    of = lambda x: F.concat(*[every(x, n) for n in lengths])
    return F.element_at(F.transform(F.array(w), of), 1)


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = BROADCAST_ROWS) -> DataFrame:
    """Per distinct (doc_id, text) with a hit: doc_id, bm_key, bm_words (1-based word positions that are hit, sorted), bm_items (item ids, sorted as strings)."""
    marks = cut(windows(benchmark, n), "bench-windows")
    about = marks.agg(F.count("*"), F.sum(F.aggregate("window", F.lit(0).cast("long"), lambda a, w: a + F.octet_length(w) + 16)), F.collect_set("len")).first()
    lengths = sorted(about[2])  # at most n of them
    texts = docs.select("doc_id", "text", text_key().alias("bm_key"))
    if not lengths:
        return texts.select("doc_id", "bm_key", F.array().cast("array<int>").alias("bm_words"), F.array().cast("array<string>").alias("bm_items")).limit(0)
    hashes = sized_broadcast(marks.select("h").distinct(), about[0], bound)
    each = texts.select("doc_id", "bm_key", F.explode(_each(word_hashes(words(F.col("text"))), lengths, lambda x, i: F.xxhash64(x))).alias("h"))
    found = cut(each.join(hashes, "h", "left_semi").select(F.col("doc_id").alias("f_id"), F.col("bm_key").alias("f_key")).distinct(), "bench-found")
    found = sized_broadcast(found, found.count(), min(bound, FOUND_ROWS))
    # the few texts found are read again and compared by their words
    again = texts.join(found, F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("bm_key") == F.col("f_key")), "left_semi")
    again = again.select("doc_id", "bm_key", F.explode(_each(words(F.col("text")), lengths, lambda x, i: F.struct(i.alias("at"), x.alias("window")))).alias("x")).select("doc_id", "bm_key", "x.at", "x.window")
    said = marks.select("item_id", "window", "len")
    hit = again.join(F.broadcast(said) if about[0] <= bound and about[1] <= WORD_BYTES else said, "window")
    spans = hit.groupBy("doc_id", "bm_key").agg(F.collect_set(F.struct("at", "len")).alias("spans"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("bm_items"))
    hit_words = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))))
    return spans.select("doc_id", "bm_key", hit_words.alias("bm_words"), "bm_items")


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = BROADCAST_ROWS) -> DataFrame:
    """``docs`` with bm_words and bm_items (empty for clean documents)."""
    hits = cut(scan(docs, benchmark, n, bound).withColumnsRenamed({"doc_id": "hit_id", "bm_key": "hit_key", "bm_words": "w", "bm_items": "i"}), "bench-hits")
    keyed = packed(docs, doc_id=docs["doc_id"], doc_key=text_key(docs["text"]))
    out = keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("doc_key") == F.col("hit_key")), "left")
    out = out.withColumn("bm_words", F.coalesce("w", F.array().cast("array<int>"))).withColumn("bm_items", F.coalesce("i", F.array().cast("array<string>")))
    return unpacked(out, docs, "bm_words", "bm_items")


def drop_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, bound: int = BROADCAST_ROWS) -> DataFrame:
    """The documents without any hit, unchanged."""
    hits = cut(scan(docs, benchmark, n, bound).select(F.col("doc_id").alias("hit_id"), F.col("bm_key").alias("hit_key")), "bench-hits")
    hits = sized_broadcast(hits, hits.count(), min(bound, FOUND_ROWS))
    keyed = packed(docs, doc_id=docs["doc_id"], doc_key=text_key(docs["text"]))
    return unpacked(keyed.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("doc_key") == F.col("hit_key")), "left_anti"), docs)


def drop_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """All documents; those with hits keep the words that aren't hit, lower-cased as compared and joined by one space."""
    marked = mark(packed(docs, doc_id=docs["doc_id"], text=docs["text"]), benchmark, n)
    kept = F.filter(words(F.col("text")), lambda w, i: ~F.array_contains("bm_words", i + 1))
    text = F.when(F.size("bm_words") > 0, F.array_join(kept, " ")).otherwise(F.col("text"))
    return unpacked(marked.withColumn("row", F.col("row").withField("text", text)), docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    hits = scan(docs, bench).select(F.col("doc_id").alias("hit_id"), "bm_key", F.size("bm_words").cast("long").alias("hit"), F.size("bm_items").cast("long").alias("items"), F.sha2(F.array_join("bm_items", ","), 256).alias("sha"))
    counted = docs.select("doc_id", F.size(words(F.col("text"))).cast("long").alias("n_words"), text_key().alias("doc_key"))
    out = counted.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("doc_key") == F.col("bm_key")), "left")
    return out.select("doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("hit").isNotNull().alias("contaminated"))


ORACLE = r"""
with d as (select doc_id, row_number() over () rid, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from documents),
b as (select item_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') w from benchmark),
m as (select distinct item_id, least(len(w), 10) n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') g from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) i from b where len(w) > 0)),
g as (select rid, i, n, array_to_string(w[i:i + n - 1], ' ') g from (select rid, w, n, unnest(range(1, len(w) - n + 2)) i from d, (select distinct n from m) where len(w) >= n)),
h as (select rid, i, g.n, item_id from g join m on g.g = m.g and g.n = m.n),
c as (select rid, count(distinct p) n_hit from (select rid, unnest(range(i, i + n)) p from h) group by rid),
t as (select rid, count(*) n_items, string_agg(x, ',' order by x) ids from (select distinct rid, item_id::varchar x from h) group by rid)
select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items, sha256(coalesce(ids, '')) items_sha256, n_hit is not null contaminated
from d left join c using (rid) left join t using (rid)"""
