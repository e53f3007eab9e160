"""Column functions over texts: segmentation, packing, normalisation, extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A sentence runs to its closing marks; a word is a run without white space; most words of a fragment.
SENTENCE, WORD, FRAGMENT_WORDS = r"[^.!?\n]+[.!?]*", r"[^\s]+", 320


def let(value: Column, fn) -> Column:
    """fn(value) with value computed once per row; the optimizer copies an expression into every lambda that mentions it."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def strip(text) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def words(text) -> Column:
    """Number of words."""
    return F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long")


def sentences(text) -> Column:
    """array<struct<text, words>>: trimmed sentences, blank ones left out."""
    found = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(SENTENCE), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(found, lambda x: F.struct(x.alias("text"), words(x).alias("words")))


def fill(sizes, limit: int, close_at_limit: bool = False) -> list[tuple[int, int]]:
    """(bin, place in it) of each size, filled in order: a bin that isn't empty (closing at the limit: that holds anything) closes before a size that would exceed ``limit`` (and at the limit if so asked)."""
    out, now, held, at = [], 0, 0, 0
    for n in sizes:
        if held + n > limit and (at > 0 if close_at_limit else held > 0) or close_at_limit and at > 0 and held >= limit:
            now, held, at = now + 1, 0, 0
        out.append((now, at))
        held += n
        at += 1
    return out


def packed(sizes: Column, limit: int, close_at_limit: bool = False) -> Column:
    """array<struct<bin, at>> of ``fill``. A loop over one array in an Arrow worker: folding with aggregate() would copy what it has made for every size. Not for use within a lambda."""
    both = F.pandas_udf(lambda s: s.map(lambda x: [b << 32 | a for b, a in fill(x, limit, close_at_limit)]), "array<bigint>")(sizes)
    return F.transform(both, lambda x: F.struct(F.shiftright(x, 32).alias("bin"), x.bitwiseAND(F.lit(2**32 - 1)).alias("at")))


def collapse(text) -> Column:
    """White space runs become one space; trimmed."""
    return strip(F.regexp_replace(text, r"\s+", " "))


def truncate(text, limit: int = 80) -> Column:
    """Collapsed text of at most ``limit`` characters, the cut marked; '(none)' when empty."""
    one = collapse(text)
    return F.when(one == "", F.lit("(none)")).when(F.char_length(one) > limit, F.concat(F.substring(one, 1, limit), F.lit("..."))).otherwise(one)


def paragraphs(text) -> Column:
    """Blocks between blank lines, inner line ends as spaces, empty ones left out."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda x: strip(F.regexp_replace(x, r"\s*\n\s*", " "))), lambda x: x != "")


def xml_escape(text) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def language_code(code) -> Column:
    return F.coalesce(F.nullif(strip(code), F.lit("")), F.lit("und"))


def ascii_normal(text) -> Column:
    """The comparison form for ASCII texts: no white space, no punctuation or symbols, lower case."""
    return F.lower(F.regexp_replace(text, r"[^0-9A-Za-z]+", ""))


def strip_chunk_tags(text) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"<chunk(?:\s+[^>]*)?>", ""), "</chunk>", "")


def unfence(text) -> Column:
    """The content of a text that is one code fence as a whole."""
    inner = F.regexp_extract(text, r"(?s)\A```(?:\w+)?[^\S\n]*\n(.*?)\n```\z", 1)
    return F.when(text.rlike(r"(?s)\A```(?:\w+)?[^\S\n]*\n.*?\n```\z"), strip(inner)).otherwise(text)


#: The heading of the wanted section, in either language, and what ends it.
_HEADING = r"##\s*(?:Compressed\s+Text|压缩文本)\s*"


def compressed_text(response) -> Column:
    """The section under the heading, up to a rule or the closing remark; the whole response without one."""
    pattern = rf"(?is){_HEADING}\n+(.*?)(?:\n+---|\*\*CRITICAL\*\*|\z)"
    return F.when(response.rlike(pattern), unfence(strip(F.regexp_extract(response, pattern, 1)))).otherwise(unfence(strip(response)))


def thinking_text(response) -> Column:
    """What stands before the heading."""
    return F.when(response.rlike(f"(?i){_HEADING}"), strip(F.regexp_extract(response, rf"(?is)\A(.*?){_HEADING}", 1))).otherwise(F.lit(""))


def json_text(response) -> Column:
    """The outermost array if it begins before the outermost object, else that object, else the text; code fences are taken off first."""
    bare = F.regexp_replace(response, r"(?s)```(?:json)?\s*\n(.*?)\n```", "$1")
    array, obj = F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.regexp_extract(bare, r"(?s)\{.*\}", 0)
    first = (array != "") & ((obj == "") | (F.instr(bare, "[") < F.instr(bare, "{")))
    return F.when(first, array).when(obj != "", obj).otherwise(strip(bare))
