r"""Operator 4: chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the text holds all turns up
to it, and only its reply is trainable. Turns that follow the last reply (or a
conversation without one) make one more example without a target, so nothing of
a conversation is lost. A turn reads ``<|turn|>role\ntext<|end|>``. Inside role
and text a backslash is doubled and a backslash is put behind the first
character of every control string; taking each backslash away and leaving the
character behind it restores the text.

Rows are sorted by conversation and turn within a partition and read as a
stream: a worker holds the running prefix of one conversation, never a group of
rows. The examples of one conversation grow with the square of its turns; that
is the method.

Defined cases: null text or role is empty; rows of one turn are ordered by role,
then text; null conv_id is one conversation, null turns come first; an empty
table has no examples; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, table

TURN, END = "<|turn|>", "<|end|>"
#: Control strings of this and of common other templates; "<|" begins all of the form <|...|>.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
EXAMPLES = "conv_id long, example int, text string, target_start int, target_end int, closing boolean"
ROWS = 256
_ESCAPED = re.compile(r"\\(.)", re.S)
_PARTS = re.compile(re.escape(TURN) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    text = text.replace("\\", "\\\\")
    for x in CONTROL:
        text = text.replace(x, f"{x[0]}\\{x[1:]}")
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The formatted turn, and where its text begins."""
    head = TURN + escape(role).replace("\n", "\\\n") + "\n"
    return head + escape(text) + END, len(head)


def read_turns(example: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    return [(unescape(m[1]), unescape(m[2])) for m in _PARTS.finditer(example)]


def _by_conversation(rows: DataFrame, *order) -> DataFrame:
    small_batches(rows.sparkSession)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def examples(conversations: DataFrame) -> DataFrame:
    """conv_id, example, text, target_start, target_end (code points; null without a target), closing (the last of its conversation)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int32()), ("text", pa.string()), ("target_start", pa.int32()), ("target_end", pa.int32()), ("closing", pa.bool_())])
        now, prefix, n, waiting, out, held = None, "", 0, None, [], 0
        begun = False

        def close():
            nonlocal waiting, n, held
            if not begun:
                return
            if waiting is None or len(waiting[2]) < len(prefix):  # turns after the last reply, or no reply
                if waiting is not None:
                    out.append(waiting)
                waiting = (now, n, prefix, None, None, True)
            out.append((*waiting[:5], True))
            held += len(waiting[2])

        for batch in batches:
            for conv, role, text in zip(batch.column("conv_id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if not begun or conv != now:
                    close()
                    now, prefix, n, waiting, begun = conv, "", 0, None, True
                piece, at = format_turn(role or "", text or "")
                start = len(prefix) + at
                prefix += piece
                if role == "assistant":
                    if waiting is not None:
                        out.append(waiting)
                        held += len(waiting[2])
                    waiting = (conv, n, prefix, start, len(prefix) - len(END), False)
                    n += 1
                if len(out) >= ROWS or held >= 4 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)
                    out, held = [], 0
        close()
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in out], schema)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return _by_conversation(rows, "turn", "role", "text").mapInArrow(run, EXAMPLES)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def read_back(made: DataFrame) -> DataFrame:
    """One row per conversation, from its examples alone: the turns from the closing example, the loss text from the masks of all.

    ``made`` is the output of examples(), whose rows of one conversation follow each other within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, examples_, loss, total = 0, 0, hashlib.sha256(), 0
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                total += len(x["text"])
                examples_ += 1
                if x["target_start"] is not None:
                    said = unescape(x["text"][x["target_start"] : x["target_end"]])
                    chars += len(said)
                    loss.update(said.encode())
                if x["closing"]:
                    turns = read_turns(x["text"])
                    sha = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in turns).encode()).hexdigest()
                    out.append({"conv_id": x["conv_id"], "n_turns": len(turns), "turns_sha256": sha, "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total, "n_examples": examples_})
                    chars, examples_, loss, total = 0, 0, hashlib.sha256(), 0
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([(k, pa.string() if "sha256" in k else pa.int64()) for k in out[0]]))

    return made.mapInArrow(run, DIGEST)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return read_back(examples(rows))


def _oracle() -> str:
    def escaped(x: str) -> str:
        x = f"replace({x}, '\\', '\\\\')"
        for c in CONTROL:
            x = f"replace({x}, '{c}', '{c[0]}\\{c[1:]}')"
        return x

    return rf"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
f as (select *, {len(TURN) + 1 + len(END)} + len({escaped("role")}) + (len(role) - len(replace(role, chr(10), ''))) + len({escaped("text")}) as n, row_number() over (partition by conv_id order by turn nulls first, role, text) as k, count(*) over (partition by conv_id) as total from c),
g as (select *, sum(n) over (partition by conv_id order by k) as upto from f)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(len(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  coalesce(sum(upto) filter (role = 'assistant' or k = total), 0)::bigint as formatted_chars, (count(*) filter (role = 'assistant' or k = total))::bigint as n_examples
from g group by conv_id"""


ORACLE = _oracle()
