"""Token ids as binary files of patched frame-of-reference blocks.

A file holds a stream of 32-bit ids cut into blocks of 512. A block stores its minimum, and
each id less the minimum in the low bits of a width that covers a chosen percentile of the
block. What does not fit is patched: an exception list holds the positions and the high
bits. The block index at the end of the file has every block's start, so a reader decodes
any range of ids without the blocks before it.

Layout (little endian): blocks; block index; document index; trailer. A block is 64 * width
bytes of packed low parts, then its exceptions: 16-bit positions, then 32-bit high parts.

Documents are range-partitioned and sorted by id, encoded and written by the tasks, one file
each, under a name of the attempt's own. The manifest, written when all tasks are done, names
the files that count, so a task that runs twice leaves a stray file but no double rows. Files
go through ``pyarrow.fs`` to the folder given, which all executors must reach.

Defined cases: a null text is empty and gives only the end id; null document ids come first;
rows of equal id are ordered by a hash of the text; equal rows are neighbours in any order; an
empty table gives no files; other columns are ignored. Ids must be integers.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexloom import session
from lexloom.llm import arrays as ar

BLOCK = 512
PERCENTILE = 0.95
MAGIC = b"lexpfor1"
INDEX = np.dtype([("at", "<u8"), ("low", "<u4"), ("count", "<u2"), ("patched", "<u2"), ("width", "u1")])
DOCS = np.dtype([("id", "<i8"), ("known", "u1"), ("n", "<u8")])
TRAILER = np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8"), ("index", "<u8")])


def pack(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bits of rows of 512 values, eight values to ``width`` bytes."""
    eight = values.reshape(-1, 8).astype(np.uint64) & np.uint64((1 << width) - 1)
    out = np.zeros((len(eight), width), np.uint8)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = eight[:, j] << np.uint64(shift)
        for b in range((shift + width + 7) // 8):
            out[:, byte + b] |= (value >> np.uint64(8 * b)).astype(np.uint8)
    return out.reshape(len(values), -1)


def unpack(packed: np.ndarray, width: int) -> np.ndarray:
    groups = packed.reshape(-1, width)
    out = np.zeros((len(groups), 8), np.uint32)
    for j in range(8):
        byte, shift = divmod(j * width, 8)
        value = np.zeros(len(groups), np.uint64)
        for b in range((shift + width + 7) // 8):
            value |= groups[:, byte + b].astype(np.uint64) << np.uint64(8 * b)
        out[:, j] = (value >> np.uint64(shift)) & np.uint64((1 << width) - 1)
    return out.reshape(len(packed), -1)


def bits(values: np.ndarray) -> np.ndarray:
    """Number of bits of each value."""
    return np.ceil(np.log2(values.astype(np.float64) + 1)).astype(np.uint8)


def encode_blocks(ids: np.ndarray, at: int, percentile: float = PERCENTILE) -> tuple[list[bytes], np.ndarray]:
    """Bytes and index of the blocks that hold ``ids``; the last may be short."""
    n = -(-len(ids) // BLOCK)
    rows = np.full(n * BLOCK, ids[-1], np.uint32)
    rows[: len(ids)] = ids
    rows = rows.reshape(n, BLOCK)
    index = np.zeros(n, INDEX)
    index["low"] = rows.min(axis=1)
    index["count"] = BLOCK
    index["count"][-1] = len(ids) - (n - 1) * BLOCK
    rest = rows - index["low"][:, None]
    place = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    index["width"] = bits(np.partition(rest, place, axis=1)[:, place])
    parts: list[bytes] = [b""] * n
    for width in np.unique(index["width"]).tolist():
        own = np.flatnonzero(index["width"] == width)
        low = pack(rest[own], width) if width else np.zeros((len(own), 0), np.uint8)
        high = rest[own].astype(np.uint64) >> np.uint64(width)
        row, position = np.nonzero(high)
        counts = np.bincount(row, minlength=len(own))
        index["patched"][own] = counts
        ends = np.cumsum(counts)
        position, high = position.astype("<u2"), high[row, position].astype("<u4")
        for i, (block, end, count) in enumerate(zip(own.tolist(), ends.tolist(), counts.tolist())):
            parts[block] = low[i].tobytes() + (position[end - count:end].tobytes() + high[end - count:end].tobytes() if count else b"")
    sizes = np.fromiter(map(len, parts), np.int64, n)
    index["at"] = at + np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return parts, index


def decode_blocks(data: np.ndarray, index: np.ndarray) -> np.ndarray:
    """Ids of consecutive blocks; ``data`` starts with the first of them."""
    out = np.zeros((len(index), BLOCK), np.uint32)
    start = (index["at"] - index["at"][0]).astype(np.int64)
    for width in np.unique(index["width"]).tolist():
        own = np.flatnonzero(index["width"] == width)
        size = width * BLOCK // 8
        if width:
            out[own] = unpack(data[start[own][:, None] + np.arange(size)], width)
        for i in own[index["patched"][own] > 0].tolist():
            n, at = int(index["patched"][i]), start[i] + size
            position, high = data[at:at + 2 * n].view("<u2"), data[at + 2 * n:at + 6 * n].tobytes()
            out[i, position] |= np.frombuffer(high, "<u4") << np.uint32(width)
    out += index["low"][:, None]
    keep = np.arange(BLOCK) < index["count"][:, None]
    return out[keep] if not keep[-1].all() else out.ravel()


class Writer:
    """Writes one file; holds at most ``hold`` ids and the indexes."""

    def __init__(self, fs: FileSystem, path: str, hold: int = BLOCK * 2048):
        self.out, self.hold, self.at, self.ids = fs.open_output_stream(path), hold, 0, 0
        self.waiting: list[np.ndarray] = []
        self.size, self.index, self.docs = 0, [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is not None, len(ids)))
        self.waiting.append(ids)
        self.size += len(ids)
        self.ids += len(ids)
        if self.size >= self.hold:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // BLOCK * BLOCK
        for first in range(0, cut, self.hold):
            parts, index = encode_blocks(ids[first:min(cut, first + self.hold)], self.at)
            data = b"".join(parts)
            self.out.write(data)
            self.at += len(data)
            self.index.append(index)
        self.waiting, self.size = [ids[cut:].copy()], len(ids) - cut

    def close(self) -> None:
        self._flush(True)
        index = np.concatenate(self.index) if self.index else np.zeros(0, INDEX)
        docs = np.array(self.docs, DOCS)
        trailer = np.array([(len(index), len(docs), self.ids, self.at)], TRAILER)
        self.out.write(index.tobytes() + docs.tobytes() + trailer.tobytes() + MAGIC)
        self.out.close()


class Reader:
    """Reads a file by its indexes."""

    def __init__(self, fs: FileSystem, path: str):
        self.file = fs.open_input_file(path)
        end = self.file.size() - len(MAGIC) - TRAILER.itemsize
        tail = self.file.read_at(TRAILER.itemsize + len(MAGIC), end)
        if tail[TRAILER.itemsize:] != MAGIC:
            raise ValueError(f"{path} is not a token file")
        self.trailer = np.frombuffer(tail, TRAILER, 1)[0]
        at, n = int(self.trailer["index"]), int(self.trailer["blocks"])
        held = self.file.read_at(end - at, at)
        self.index = np.frombuffer(held, INDEX, n)
        self.docs = np.frombuffer(held, DOCS, int(self.trailer["docs"]), n * INDEX.itemsize)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks first to last - 1."""
        at = int(self.index["at"][first])
        end = int(self.index["at"][last]) if last < len(self.index) else int(self.trailer["index"])
        return decode_blocks(np.frombuffer(self.file.read_at(end - at, at), np.uint8), self.index[first:last])

    def ids(self, start: int, n: int) -> np.ndarray:
        """Any range of ids, from the blocks that hold it."""
        if not n:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, -(-(start + n) // BLOCK)
        return self.blocks(first, last)[start - first * BLOCK:][:n]

    def documents(self, step: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
        """Row of the document index and its next ids, again and again; a long document comes in pieces."""
        ends = np.cumsum(self.docs["n"].astype(np.int64))
        doc, at = 0, 0
        for first in range(0, len(self.index), step):
            ids = self.blocks(first, min(len(self.index), first + step))
            used = 0
            while used < len(ids):
                take = min(len(ids) - used, int(ends[doc]) - at)
                yield doc, ids[used:used + take]
                used, at = used + take, at + take
                if at == ends[doc]:
                    doc += 1


#: Characters below this have had their Unicode class for long; others may be classed differently by two libraries.
_SURE = 0x530


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_SURE) if unicodedata.category(chr(c))[0] in kinds)


#: How byte-level vocabularies split a text before merging, spelt out for characters below ``_SURE``.
_BLANK, _LETTER, _NUMBER = r"\t-\r \x85\xa0", _class("L"), _class("N")
_SPLIT = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_BLANK}{_LETTER}{_NUMBER}]+|[{_BLANK}]+(?![^{_BLANK}])|[{_BLANK}]+")


class _Unsure(Exception):
    pass


class _Pieces(dict):
    """Ids of every piece as bytes, encoded once by the library and kept while there is room."""

    LIMIT = 400_000

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if not piece.isascii() and ord(max(piece)) >= _SURE:
            raise _Unsure
        got = np.array(self.encode(piece), "<u4").tobytes()
        if len(self) < self.LIMIT:
            self[piece] = got
        return got


class Encoder:
    """Texts to ids with a vocabulary of the tokenizers library.

    Byte-level vocabularies merge only inside the pieces of their pattern, so the library's
    model encodes every piece once and it is looked up after. Texts with an added token or with characters outside
    the older alphabets, and other vocabularies, go through the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        self.by_piece = plain and rules["normalizer"] is None and rules["model"]["type"] == "BPE"
        self.added = [t["content"] for t in rules["added_tokens"]]
        self.pieces = _Pieces(self._piece)
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        unseen = [b for b in range(256) if b not in seen]
        #: Byte-level models see each byte as a printable character, the rest from 256 on.
        self.shown = {b: b for b in seen} | {b: 256 + i for i, b in enumerate(unseen)}

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(piece.encode().decode("latin-1").translate(self.shown))]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> np.ndarray:
        if not self.by_piece or any(t in text for t in self.added):
            return np.array(self._whole(text), "<u4")
        found, parts = (m.group() for m in _SPLIT.finditer(text)) if len(text) > 1 << 20 else iter(_SPLIT.findall(text)), []
        try:
            while part := b"".join(map(self.pieces.__getitem__, islice(found, 1 << 16))):
                parts.append(part)
        except _Unsure:
            return np.array(self._whole(text), "<u4")
        return np.frombuffer(b"".join(parts), "<u4")


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and writes all rows; the manifest: part, path, docs, ids and start of every file."""
    spark = docs.sparkSession
    ar.small_batches(spark)
    home = f"{folder.rstrip('/')}/tokens-{uuid.uuid4().hex[:12]}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, writer = encoder(tokenizer), None
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
        for batch in batches:
            if batch.num_rows and writer is None:
                fs, root = FileSystem.from_uri(home)
                fs.create_dir(root, recursive=True)
                writer = Writer(fs, f"{root}/{name}")
            for doc, t in zip(batch.column("k").to_pylist(), batch.column("t").to_pylist()):
                writer.add(doc, np.append(made.encode(t or ""), np.uint32(end_id)).astype("<u4"))
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": [task.partitionId()], "path": [f"{home}/{name}"], "docs": [len(writer.docs)], "ids": [writer.ids]})

    # The last part of the range key lets rows that are equal be dealt to several tasks.
    rows = docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"))
    dealt = rows.repartitionByRange("k", F.xxhash64("t"), F.xxhash64(F.monotonically_increasing_id()))
    files = dealt.sortWithinPartitions("k", F.xxhash64("t")).mapInArrow(run, "part long, path string, docs long, ids long")
    manifest = session.save(files, "token-files")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return session.save(manifest.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0))), "token-files")


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, read from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                fs, at = FileSystem.from_uri(path)
                reader = Reader(fs, at)
                docs = reader.docs
                crc = np.zeros(len(docs), np.int64)
                for doc, ids in reader.documents():
                    crc[doc] = zlib.crc32(np.ascontiguousarray(ids, "<u4"), int(crc[doc]))
                n = docs["n"].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(docs["id"], mask=docs["known"] == 0), pa.array(start + np.cumsum(n) - n), pa.array(n), pa.array(crc),
                ], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
