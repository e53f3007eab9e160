"""Fragments from a stream of text pieces (STR1, STR2): state is the unfinished remainder of each serial, its open fragment and its next numbers."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import FRAGMENT_WORDS
from ..session import shared_folder

_CLOSED = re.compile(r"[^.!?\n]*[.!?]+|[^.!?\n]+\n|\n")
_SAID = re.compile(r"[^.!?\s]")
OUT = "serial_id long, fragment_id long, sentence_index long, text string, words long"
STATE = "rest string, held long, fragment long, sentence long"


def cut(text: str, flush: bool) -> tuple[list[str], str]:
    """Whole sentences of a growing text, and what is held back: a sentence may go on until a mark is followed by something else."""
    out, at = [], 0
    for m in _CLOSED.finditer(text):
        if m.end() == len(text) and not flush and m[0][-1] != "\n":
            break
        out.append(m[0].strip())
        at = m.end()
    if flush:
        out.append(text[at:].strip())
        at = len(text)
    return [x for x in out if _SAID.search(x)], text[at:]


def fold(serial: int, pieces: list[str], state: tuple[str, int, int, int], flush: bool, limit: int = FRAGMENT_WORDS) -> tuple[list[tuple], tuple[str, int, int, int]]:
    rest, held, fragment, index = state
    found, rest = cut(rest + "".join(pieces), flush)
    rows = []
    for text in found:
        n = len(text.split())
        if held > 0 and held + n > limit:
            fragment, held, index = fragment + 1, 0, 0
        rows.append((serial, fragment, index, text, n))
        held, index = held + n, index + 1
    return rows, (rest, held, fragment, index)


def pack_stream(pieces: DataFrame, limit: int = FRAGMENT_WORDS) -> DataFrame:
    """pieces: serial_id, seq, text, last. Pieces of one batch are put in order of seq; a serial's last piece (last = true) flushes its state."""

    def run(key, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        before = tuple(state.get) if state.exists else ("", 0, 0, 0)
        done = bool(rows["last"].any())
        out, after = fold(int(key[0]), rows["text"].tolist(), before, done, limit)
        if done:
            state.remove()
        else:
            state.update(after)
        yield pd.DataFrame(out, columns=["serial_id", "fragment_id", "sentence_index", "text", "words"])

    return pieces.groupBy("serial_id").applyInPandasWithState(run, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def pack_available(spark: SparkSession, path: str, limit: int = FRAGMENT_WORDS) -> DataFrame:
    """All documents (doc_id, text) found under a path now, read as a stream and packed; the result is a table in the shared folder."""
    source = spark.readStream.schema("doc_id long, text string").parquet(path)
    pieces = source.select(F.col("doc_id").alias("serial_id"), F.lit(0).cast("long").alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("last"))
    folder = f"{shared_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    query = pack_stream(pieces, limit).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(OUT).parquet(f"{folder}/out")
