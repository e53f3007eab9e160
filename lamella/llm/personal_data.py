r"""Operator 7: personal data by bootstrapped contextual extraction.

Base entities are found by fixed rules (email, ip, card, phone). They are the
seeds of the method. Further candidates are tokens that look like no word: a digit
or an @ among at least ``LEAST_CHARS`` characters, whatever their shape (account
numbers, keys, passwords, a card number with a wrong check digit). A seed or candidate is
an instance; its lexical patterns are the one and the two words before it, the one
and the two words after it (what stands before the value in ``name=value`` is
the word before), and, for candidates, their form: the kinds of their characters
and their length. Spark scores the graph of patterns and instances in ``ROUNDS``
rounds. A round induces patterns from the seeds and from the instances that the
rounds before have found: those in which at least ``SUPPORT`` such instances from as many
documents stand, and whose confidence, the mean score of all their instances, is at
least ``CONFIDENCE``. An instance's score is one minus the product of its patterns' doubts;
it is found at ``FOUND``. Instances that nothing speaks for lower the confidence of their patterns, so common words
alone extract nothing where dates and the like are common; but they aren't counterexamples, so the
least confidence is low and it takes several patterns to find an instance. Base spans always stay, and no added span overlaps one.

Shape: one pass over the text returns a few numbers and digests per instance;
everything after works on those. Edges are distinct (pattern, instance, document);
scores are joined, never collected, and written each round, so that joins are of two plain
exchanges that the planner can split at a very common pattern.

Defined cases: null text is empty; rows that share a doc_id are told apart by
their text; an empty table, or one without entities, gives zeros; other columns
are ignored. Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, map_arrow, table, text_key

#: The base kinds in the order of the listing; OTHER is what patterns find beside them.
KINDS = ("email", "ip", "card", "phone")
OTHER = "other"
ROUNDS, SUPPORT, CONFIDENCE, FOUND = 5, 5, 0.2, 0.8
LEAST_CHARS = 8
#: The base patterns. A run of digits is tried from its first digit only: what fails there fails later in the run.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Tokens with a digit or an @, numbers written in groups, what comes before a value, and punctuation around a token.
ODD = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
GROUPS = re.compile(r"(?<![^\W_])\+?[0-9](?:[\x20().-]{0,2}[0-9]){6,}(?![^\W_])")
KEY = re.compile(r"[A-Za-z_.-]+[=:](?=.)")
AROUND = "\"'`()[]{}<>,;.:!?"
TOKEN = re.compile(r"\S+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
_DIGIT, _NOT_DIGIT = re.compile(r"[0-9]"), re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of local@domain: the longest local part before each @, not before the last match's end."""
    done, at = 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            s = at
            while s > done and not _NOT_LOCAL.match(text, s - 1):
                s -= 1
            if s < at:
                yield s, m.end()
                done = at = m.end() - 1
                done += 1
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def base(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base entities, by start, then kind."""
    out = []
    if "@" in text:
        out += [(s, 0, e) for s, e in emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = _NOT_DIGIT.sub("", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return [(s, KINDS[k], e) for s, k, e in sorted(out)]


def odd_tokens(text: str, taken: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of the candidates: they overlap neither a base entity nor each other; a number in groups goes before the tokens that it is made of."""
    ends = [e for _, _, e in sorted(taken, key=lambda x: x[2])]
    starts = sorted(s for s, _, _ in taken)
    free = lambda s, e: bisect_left(starts, e) == bisect_right(ends, s)
    out = [m.span() for m in GROUPS.finditer(text) if m.end() - m.start() >= LEAST_CHARS and free(*m.span())]
    numbers = [s for s, _ in out], [e for _, e in out]
    for m in ODD.finditer(text):
        s, e = m.span()
        while e > s and text[e - 1] in AROUND:
            e -= 1
        key = KEY.match(text, s, e)
        s = key.end() if key else s
        while s < e and text[s] in AROUND:
            s += 1
        if e - s >= LEAST_CHARS and free(s, e) and bisect_left(numbers[0], e) == bisect_right(numbers[1], s):
            if "@" in text[s:e] or _DIGIT.search(text, s, e):
                out.append((s, e))
    return sorted(out)


def kind_of(token: str) -> str:
    """What kind a found token is listed as."""
    digits = _NOT_DIGIT.sub("", token)
    if "@" in token:
        return "email"
    if re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", token):
        return "ip"
    if re.fullmatch(r"[0-9](?:[\x20-]?[0-9])+", token) and 12 <= len(digits) <= 19:
        return "card"
    if token[0] == "+" and 9 <= len(digits) <= 15:
        return "phone"
    return OTHER


def form(token: str) -> str:
    """The kinds of a token's characters, and its length."""
    kinds = {"0" if "0" <= c <= "9" else "a" if c.islower() else "A" if c.isupper() else c if c < "\x80" and not c.isspace() else "?" for c in token}
    return "".join(sorted(kinds)) + str(len(token))


def contexts(text: str, spans: list[tuple[int, int]]) -> list[tuple[str, str, str, str]]:
    """For each span the one and the two words before it, the one and the two words after it: lower-cased, digits as 0; the rest of its own token counts as a word, tokens of punctuation don't."""
    words = [m.span() for m in TOKEN.finditer(text)]
    first, last = [s for s, _ in words], [e for _, e in words]

    def two(k: int, step: int, s: int, e: int) -> list[str]:
        out: list[str] = []
        while 0 <= k < len(words) and len(out) < 2:
            a, b = words[k]
            word = text[a : min(b, s)] if step < 0 else text[max(a, e) : b]
            if word.strip(AROUND):
                out.append(word)
            k += step
        return [_DIGIT.sub("0", x.lower()) for x in out]

    out = []
    for s, e in spans:
        left, right = two(bisect_left(first, s) - 1, -1, s, e), two(bisect_right(last, e), 1, s, e)
        out.append((left[0] if left else "^", " ".join(left[::-1]) if len(left) == 2 else "^ " + "".join(left), right[0] if right else "$", " ".join(right) if len(right) == 2 else "".join(right) + " $"))
    return out


def _digest(x: str) -> bytes:
    return hashlib.blake2b(x.encode("utf-8", "surrogatepass"), digest_size=12).digest()


def instances(text: str) -> list[tuple]:
    """(start, end, kind, base, instance, patterns) in text order."""
    if "@" not in text and not _DIGIT.search(text):
        return []
    known = base(text)
    every = sorted([(s, e, k, True) for s, k, e in known] + [(s, e, kind_of(text[s:e]), False) for s, e in odd_tokens(text, known)])
    if not every:
        return []
    around = contexts(text, [x[:2] for x in every])
    out = []
    for (s, e, kind, seed), four in zip(every, around, strict=True):
        patterns = [_digest(f"{place}:{x}") for place, x in zip("lLrR", four, strict=True)]
        out.append((s, e, kind, seed, _digest(text[s:e].lower()), patterns if seed else [*patterns, _digest("f:" + form(text[s:e]))]))
    return out


FOUND_TYPE = "array<struct<start:int,end:int,kind:string,base:boolean,instance:binary,patterns:array<binary>>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, tk, found: the instances of every text in its order."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_()), ("instance", pa.binary()), ("patterns", pa.list_(pa.binary()))]))
    names = ("start", "end", "kind", "base", "instance", "patterns")

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        rows = [[dict(zip(names, x, strict=True)) for x in instances(text.as_py() or "")] for text in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tk"), pa.array(rows, kind)], ["doc_id", "tk", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key().alias("tk"), "text")
    return map_arrow(rows, run, f"doc_id long, tk long, found {FOUND_TYPE}")


def bootstrap(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """instance and score of the candidates that patterns reach, after ``rounds`` rounds. occurrences: doc_id, base, instance, patterns."""
    edges = cut(occurrences.select("doc_id", "base", "instance", F.explode("patterns").alias("pattern")).distinct(), "pii-edges")
    seeds = edges.where("base").select("instance").distinct().withColumn("score", F.lit(1.0))
    scores, found = cut(seeds, "pii-seeds"), None
    for _ in range(rounds):
        scored = edges.join(scores, "instance", "left").select("pattern", "doc_id", "instance", F.coalesce("score", F.lit(0.0)).alias("score"))
        per = scored.groupBy("pattern", "instance").agg(F.max("score").alias("score")).groupBy("pattern").agg(F.avg("score").alias("confidence"), F.sum((F.col("score") >= FOUND).cast("long")).alias("support"))
        per = per.where((F.col("support") >= SUPPORT) & (F.col("confidence") >= CONFIDENCE)).select("pattern", "confidence")
        in_documents = scored.where(F.col("score") >= FOUND).select("pattern", "doc_id").distinct().groupBy("pattern").agg(F.count("*").alias("documents")).where(F.col("documents") >= SUPPORT).select("pattern")
        induced = cut(per.join(in_documents, "pattern"), "pii-patterns")
        doubt = F.sum(F.log(1 - F.least("confidence", F.lit(0.99))))
        reached = edges.where("not base").select("instance", "pattern").distinct().join(induced, "pattern").groupBy("instance").agg((1 - F.exp(doubt)).alias("score"))
        found = cut(reached, "pii-scores")
        scores = seeds.unionByName(found).groupBy("instance").agg(F.max("score").alias("score"))
    return found


def find(docs: DataFrame) -> DataFrame:
    """doc_id, tk, entities: array of (start, kind, end, base) by start, then kind, of base entities and those that patterns added."""
    seen = cut(scan(docs), "pii-scan")
    flat = seen.select("doc_id", "tk", F.explode("found").alias("x")).select("doc_id", "tk", "x.*")
    good = bootstrap(flat).where(F.col("score") >= FOUND).select("instance")
    added = flat.where("not base").join(good, "instance", "left_semi")
    added = added.groupBy("doc_id", "tk").agg(F.collect_set(F.struct("start", "kind", "end", F.lit(False).alias("base"))).alias("more")).withColumnsRenamed({"doc_id": "m_id", "tk": "m_key"})
    known = F.transform(F.filter("found", lambda x: x["base"]), lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), F.lit(True).alias("base")))
    both = seen.select("doc_id", "tk", known.alias("known")).join(added, F.col("doc_id").eqNullSafe(F.col("m_id")) & (F.col("tk") == F.col("m_key")), "left")
    none = F.array().cast("array<struct<start:int,kind:string,end:int,base:boolean>>")
    rank = lambda x: F.array_position(F.array(*map(F.lit, (*KINDS, OTHER))), x["kind"])
    order = lambda x, y: F.when(x["start"] != y["start"], x["start"] - y["start"]).otherwise((rank(x) - rank(y)).cast("int"))
    return both.select("doc_id", "tk", F.array_sort(F.concat("known", F.coalesce("more", none)), order).alias("entities"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))
    said = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    known = F.filter("entities", lambda x: x["base"])
    of = lambda k: F.size(F.filter("entities", lambda x: x["base"] & (x["kind"] == F.lit(k)))).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(said(known), 256).alias("base_sha256"), said(F.col("entities")).alias("spans"), F.size("entities").cast("long").alias("n_spans"), (F.size("entities") - F.size(known)).cast("long").alias("n_added"))
