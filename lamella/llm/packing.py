"""Operator 10: token ids, packed by best fit decreasing.

Texts become ids of a public byte-level BPE vocabulary, each document closed by
the separator id. A document longer than a row is split into full rows and a
rest, losslessly. Within a chunk of at most ``CHUNK`` tokens of one partition
pieces are packed in order of decreasing length, each into the open row whose
room is the smallest that fits; a segment tree over room sizes finds it in
O(log row length). No token is shuffled: every task packs what it reads, and its
memory is one chunk.

A packed row carries its ids (padded to ``length`` with the separator), the
cumulative segment lengths (0 first), the position at which every token's own
count starts again (one reset per segment), and per segment the doc_id and the
token offset within the document, so that documents can be put together again.

``pack`` returns these rows, ``write`` stores them as binary files, one pair for each
partition: ``part-N.ids``, the id matrix, rows of ``length`` little-endian 32-bit numbers
and nothing else, so that it can be mapped into memory; and ``part-N.meta``, an Arrow
file with the rest, row for row. A pair gets its name when it is complete, so a task that
is lost and run again leaves no half file; ``manifest.json`` comes last and lists the
parts with their rows and SHA-256. ``restore`` reads documents back from such a folder.

Defined cases: null or empty text is one separator; rows sharing a doc_id are
packed each; a null doc_id stays null; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import kernel
from .common import small_batches, table, tidy

LENGTH = 4096
SEPARATOR = 50256
CHUNK = 4 << 20
#: Words whose ids a worker remembers; it starts afresh beyond.
REMEMBERED = 200_000
VOCABULARY = "byte_bpe_50k.tiktoken"
SCHEMA = "row_id long, n_tokens int, ids array<int>, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, offsets array<long>"
#: The UTF-8 bytes of white space beyond ASCII. Texts that hold any are encoded as a whole.
RARE = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
_SPACE = frozenset(b" \t\n\x0b\x0c\r")
_encoders: dict[str, Encoder] = {}


def piece_starts(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the block can be cut so that no pre-token of the vocabulary's pattern crosses a cut.

    A word takes the one space before it along; other white space before a word stands alone, and so does what comes before that.
    """
    s, e, _ = kernel.word_bounds(raw, at)
    cut = np.zeros(len(raw) + 1, bool)
    first = np.zeros(len(raw) + 1, bool)
    first[at] = True
    inner = s[~first[s]]  # a word that doesn't begin its text has white space before it
    cut[inner - 1] = True
    cut[inner[raw[inner - 1] != 32]] = True
    cut[e] = True
    cut[at] = True
    return np.flatnonzero(cut)


class Encoder:
    """Ids of the texts of a block.

    Pieces come back often: their ids are remembered by a 64-bit hash, and only new ones are encoded, many at once. Every block is then
    decoded and compared with its bytes; one that differs (a hash collision) is encoded as a whole.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("lamella", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        by_id = sorted((b, a) for a, b in ranks.items())
        self.width, self.start = np.zeros(by_id[-1][0] + 1, np.int32), np.zeros(by_id[-1][0] + 1, np.int32)
        self.width[[b for b, _ in by_id]] = [len(a) for _, a in by_id]
        self.start[[b for b, _ in by_id]] = np.cumsum([0, *(len(a) for _, a in by_id)])[:-1]
        self.spelled = np.frombuffer(b"".join(a for _, a in by_id), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[int, int] = {}
        self.at, self.size, self.store, self.used = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32), 0

    def learn(self, hashes: list[int], pieces: list[bytes]) -> None:
        """Pieces that begin with a space and go on stay apart in one long text, and words without a space do with a line end between them, which is a token of its own; where each one's ids end follows from the widths of the ids."""
        kind = [1 if x[0] == 32 and len(x) > 1 and x[1] > 32 else 2 if x[0] not in _SPACE and not RARE.search(x) else 0 for x in pieces]
        for mine, between in ((1, b""), (2, b"\n")):
            some = [x for x, y in zip(pieces, kind, strict=True) if y == mine]
            if some:
                flat = np.array(self.bpe.encode_ordinary(between.join(some).decode()), np.int32)
                stop = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + len(between)) - len(between)
                last = np.searchsorted(np.cumsum(self.width[flat]), stop) + 1
                if between:  # the id after each piece but the last is that of the line end
                    keep = np.ones(len(flat), bool)
                    keep[last[:-1]] = False
                    flat, last = flat[keep], last - np.arange(len(last))
                self._add([h for h, y in zip(hashes, kind, strict=True) if y == mine], np.diff(last, prepend=0), flat)
        alone = [np.array(self.bpe.encode_ordinary(x.decode()), np.int32) for x, y in zip(pieces, kind, strict=True) if not y]
        if alone:
            self._add([h for h, y in zip(hashes, kind, strict=True) if not y], np.array(list(map(len, alone))), np.concatenate(alone))

    def _add(self, hashes: list[int], sizes: np.ndarray, ids: np.ndarray) -> None:
        n = len(self.known)
        while n + len(hashes) > len(self.at):
            self.at, self.size = np.concatenate((self.at, self.at)), np.concatenate((self.size, self.size))
        while self.used + len(ids) > len(self.store):
            self.store = np.concatenate((self.store, self.store))
        self.size[n : n + len(hashes)] = sizes
        self.at[n : n + len(hashes)] = self.used + np.cumsum(sizes) - sizes
        self.store[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.known.update(zip(hashes, range(n, n + len(hashes)), strict=True))

    def whole(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        return [np.array(self.bpe.encode_ordinary(raw[a:b].tobytes().decode()), np.int32) for a, b in zip(at[:-1], at[1:], strict=True)]

    def encode(self, raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Ids of each row of the block."""
        if not len(raw):
            return [np.zeros(0, np.int32) for _ in at[1:]]
        if len(self.known) > REMEMBERED:
            self.forget()
        cut = piece_starts(raw, at)
        hashes = kernel.mix(kernel.range_hash(kernel.byte_prefix(raw), cut[:-1], cut[1:]) + np.diff(cut).astype(np.uint64))
        one, where, back = np.unique(hashes, return_index=True, return_inverse=True)
        keys, data = one.tolist(), raw.tobytes()
        new = [k for k, h in enumerate(keys) if h not in self.known]
        try:
            if new:
                self.learn([keys[k] for k in new], [data[cut[where[k]] : cut[where[k] + 1]] for k in new])
            index = np.array([self.known[h] for h in keys], np.int64)[back]
            size = self.size[index]
            ends = np.cumsum(size)
            ids = self.store[np.repeat(self.at[index] - ends + size, size) + np.arange(ends[-1])]
            width = self.width[ids]
            upto = np.cumsum(width, dtype=np.int32 if len(raw) < 2**30 else np.int64)
            same = upto[-1] == len(raw) and bool((self.spelled[np.repeat(self.start[ids] - upto + width, width) + np.arange(len(raw), dtype=upto.dtype)] == raw).all())
        except (UnicodeDecodeError, ValueError):
            same = False
        if not same:
            self.forget()
            return self.whole(raw, at)
        first = np.searchsorted(np.concatenate(([0], upto)), at)
        rows = [ids[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for k in {int(np.searchsorted(at, m.start(), "right")) - 1 for m in RARE.finditer(data)}:
            rows[k] = self.whole(raw, at[k : k + 2])[0]
        return rows


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Rooms:
    """Open rows by their room, and a segment tree of how many there are over rooms 0..length."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def add(self, room: int, row: int) -> None:
        self.rows.setdefault(room, []).append(row)
        self._count(room, 1)

    def _count(self, room: int, by: int) -> None:
        i = room + self.leaves
        while i:
            self.tree[i] += by
            i >>= 1

    def best(self, size: int) -> tuple[int, int] | None:
        """Take out a row with the smallest room of at least ``size``: (room, row)."""
        i = size + self.leaves
        if not self.tree[i]:
            while i > 1 and (i & 1 or not self.tree[i + 1]):  # up to the first ancestor with something to its right
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        self._count(room, -1)
        return room, self.rows[room].pop()


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Indexes of the pieces of each row. Sizes are from 1 to ``length``; equal sizes keep their order."""
    rows: list[list[int]] = []
    rooms = Rooms(length)
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = rooms.best(sizes[k])
        if found is None:
            found = length, len(rows)
            rows.append([])
        room, row = found
        rows[row].append(k)
        rooms.add(room - sizes[k], row)
    return rows


def default_vocabulary() -> str:
    """Where the installed public vocabulary lies. Imported here, so that nothing else needs it."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pack(docs: DataFrame, length: int = LENGTH, vocabulary: str | None = None, separator: int = SEPARATOR, chunk: int = CHUNK) -> DataFrame:
    """Packed rows of the documents (doc_id, text); ``vocabulary`` is the path of a rank file that every executor has."""
    path = vocabulary or default_vocabulary()

    def emit(pieces: list[tuple], first: int) -> Iterator[pa.RecordBatch]:
        rows = best_fit_decreasing([len(p[2]) for p in pieces], length)
        for at in range(0, len(rows), 128):
            some = rows[at : at + 128]
            ids = np.full((len(some), length), separator, np.int32)
            cumulative, resets, doc_ids, offsets, n = [], [], [], [], []
            for r, row in enumerate(some):
                ends = np.cumsum([0, *(len(pieces[k][2]) for k in row)], dtype=np.int32)
                for k, start in zip(row, ends, strict=False):
                    ids[r, start : start + len(pieces[k][2])] = pieces[k][2]
                cumulative.append(ends)
                resets.append(ends[:-1])
                doc_ids.append([pieces[k][0] for k in row])
                offsets.append([pieces[k][1] for k in row])
                n.append(int(ends[-1]))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(some) + 1) * length, length, dtype=np.int32)), pa.array(ids.ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(some)) + first + at), pa.array(n, pa.int32()), flat, pa.array(cumulative, pa.list_(pa.int32())), pa.array(resets, pa.list_(pa.int32())), pa.array(doc_ids, pa.list_(pa.int64())), pa.array(offsets, pa.list_(pa.int64()))],
                ["row_id", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "offsets"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, close = encoder(path).encode, np.array([separator], np.int32)
        first, pieces, held = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, [], 0
        for batch in batches:
            for some, raw, at in kernel.blocks(batch):
                for doc_id, ids in zip(some.column(0).to_pylist(), encode(raw, at), strict=True):
                    ids = np.concatenate((ids, close))
                    pieces += [(doc_id, k, ids[k : k + length]) for k in range(0, len(ids), length)]
                    held += len(ids)
                    if held >= chunk:
                        yield from emit(pieces, first)
                        first, pieces, held = first + len(pieces), [], 0
        if pieces:
            yield from emit(pieces, first)
        pieces = []
        tidy()

    small_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(run, SCHEMA)


def write(rows: DataFrame, folder: str) -> dict:
    """Store packed rows as binary files in ``folder`` (a URI or path that every executor can write to); returns the manifest."""
    place, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    place.create_dir(root)
    meta = pa.schema([("row_id", pa.int64()), ("n_tokens", pa.int32()), ("cu_seqlens", pa.list_(pa.int32())), ("resets", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to, at = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        part, own, n, width, sha = TaskContext.get().partitionId(), uuid.uuid4().hex, 0, 0, hashlib.sha256()
        half, whole = (f"{at}/.half-{own}", f"{at}/part-{part:05}")
        ids = table_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids is None:
                ids = to.open_output_stream(f"{half}.ids")
                sink = to.open_output_stream(f"{half}.meta")
                table_ = pa.ipc.new_file(sink, meta)
            flat = batch.column("ids").flatten().to_numpy().astype("<i4").tobytes()
            width = len(batch.column("ids")[0])
            ids.write(flat)
            sha.update(flat)
            table_.write_batch(batch.select(meta.names).cast(meta))
            n += batch.num_rows
        if ids is not None:
            ids.close()
            table_.close()
            sink.close()
            for kind in ("ids", "meta"):
                to.move(f"{half}.{kind}", f"{whole}.{kind}")
            yield pa.RecordBatch.from_pydict({"part": [f"part-{part:05}"], "rows": [n], "length": [width], "sha256": [sha.hexdigest()]}, pa.schema([("part", pa.string()), ("rows", pa.int64()), ("length", pa.int64()), ("sha256", pa.string())]))

    small_batches(rows.sparkSession)
    parts = [r.asDict() for r in rows.mapInArrow(run, "part string, rows long, length long, sha256 string").collect()]  # one row for each partition
    manifest = {"dtype": "<i4", "parts": sorted(parts, key=lambda x: x["part"])}
    with place.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def restore(folder: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, offset, ids) of every segment of a folder that ``write`` has made; a part that differs from its manifest is an error."""
    place, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    with place.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    for part in manifest["parts"]:
        with place.open_input_file(f"{root}/{part['part']}.ids") as f:
            raw = f.read()
        if hashlib.sha256(raw).hexdigest() != part["sha256"]:
            raise ValueError(f"{part['part']} differs from its manifest")
        ids = np.frombuffer(raw, manifest["dtype"]).reshape(part["rows"], part["length"])
        with place.open_input_file(f"{root}/{part['part']}.meta") as f:
            rows = pa.ipc.open_file(f).read_all().to_pylist()
        for k, row in enumerate(rows):
            for j, (doc_id, offset) in enumerate(zip(row["doc_ids"], row["offsets"], strict=True)):
                yield doc_id, offset, ids[k, row["cu_seqlens"][j] : row["cu_seqlens"][j + 1]]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
