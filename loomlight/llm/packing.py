"""Bounded-space online packing of tokenised documents into sequences.

Each partition keeps a fixed number of open windows. A document's full sequences are cut off and closed at once; its
rest goes to the window that it fills best. When it fits none, the fullest window is emitted and a new one opened;
if the emitted window has room for at least MIN_CUT tokens, the head of the rest is cut to fill it. When the
partition ends, the windows still open are its leftovers. They are merged in groups of GROUP partitions, a fixed
number of windows each, by best fit in order of falling length; cutting closes the sequences there as well, and the
last one of a group is split into sequences whose lengths are powers of two, which need no padding.

Every task holds OPEN windows and one document, so memory doesn't grow with the input, and nothing is gathered on
one task or the driver. Sequence numbers are the partition's number, shifted, plus a counter.

Defined cases: a null or empty text is the end token alone; a null doc_id stays null; repeated rows are packed as often as they occur; other
columns are ignored; an empty table gives no rows. Text that spells a special token is ordinary text.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, prepare, table

LENGTH, OPEN, MIN_CUT, GROUP, END = 2048, 64, 16, 16, 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache(2)
def encoder(path: str):  # noqa: ANN201
    """Text to ids by the byte-level BPE vocabulary of a tokenizers file.

    The file's ids and its merges have one order, so a merge's rank is the id that it makes; tiktoken runs the same
    merges several times as fast. A file for which that isn't so is run by tokenizers itself.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab, merges = model["model"]["vocab"], model["model"]["merges"]
    special = {t["content"] for t in model["added_tokens"]}
    made = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in merges]
    pre = model["pre_tokenizer"] or {}
    if made == sorted(made) and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not model.get("normalizer"):
        # the printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest from 256 on
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        byte = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


class Windows:
    """Open windows by the room they have left: sorted (room, number) pairs, at most `limit` of them."""

    def __init__(self, limit: int):
        self.limit, self.by_room, self.held, self.n = limit, [], {}, 0

    def open(self) -> int:
        self.n += 1
        self.held[self.n] = []
        return self.n

    def best(self, size: int) -> int | None:
        """Take out the window with the least room that suffices."""
        at = bisect_left(self.by_room, (size, 0))
        return self.by_room.pop(at)[1] if at < len(self.by_room) else None

    def fullest(self) -> int | None:
        return self.by_room.pop(0)[1] if len(self.by_room) >= self.limit else None

    def back(self, number: int, room: int) -> None:
        insort(self.by_room, (room, number))


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens) given in turn; `out` gets (piece..., sequence, offset)."""

    def __init__(self, first: int, length: int, limit: int, min_cut: int, values):  # noqa: ANN001
        self.sequence, self.length, self.min_cut, self.values = first, length, min_cut, values
        self.windows, self.out = Windows(limit), []

    def close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.out.append((doc_id, start, len(ids), self.values(ids), total, self.sequence, at))
            at += len(ids)
        self.sequence += 1

    def add(self, doc_id: int, ids: np.ndarray, total: int, start: int = 0) -> None:
        length, w = self.length, self.windows
        end = start + len(ids)
        while end - start >= length:
            self.close([(doc_id, start, ids[:length], total)])
            ids, start = ids[length:], start + length
        while len(ids):
            number = w.best(len(ids))
            if number is None and (number := w.fullest()) is not None:
                room = length - sum(len(p[2]) for p in w.held[number])
                if room >= self.min_cut and len(ids) - room >= self.min_cut:
                    w.held[number].append((doc_id, start, ids[:room], total))
                    ids, start = ids[room:], start + room
                self.close(w.held.pop(number))
                continue
            number = w.open() if number is None else number
            pieces = w.held[number]
            pieces.append((doc_id, start, ids, total))
            room = length - sum(len(p[2]) for p in pieces)
            if room:
                w.back(number, room)
            else:
                self.close(w.held.pop(number))
            return


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _pack(batches: Iterator[pa.RecordBatch], path: str, length: int, limit: int, min_cut: int, end: int) -> Iterator[pa.RecordBatch]:
    """Pack a partition; leftovers carry their ids and no sequence."""
    encode, number = encoder(path), TaskContext.get().partitionId()
    packer = Packer(number << 40, length, limit, min_cut, _crc)

    def batch(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 7
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols] + [pa.array([number] * len(rows), pa.int32()), pa.array(ids, pa.binary())], [*names, "source_partition", "ids"])

    for b in batches:
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), end], np.uint32)
            packer.add(doc_id, ids, len(ids))
            if len(packer.out) >= 5000:
                yield batch(packer.out, [None] * len(packer.out))
                packer.out = []
    yield batch(packer.out, [None] * len(packer.out))
    left = [(d, s, len(i), _crc(i), t, None, None) for pieces in packer.windows.held.values() for d, s, i, t in pieces]
    yield batch(left, [i.astype("<u4").tobytes() for pieces in packer.windows.held.values() for _, _, i, _ in pieces])


def _merge(leftovers: pa.Table, length: int, min_cut: int) -> pa.Table:
    """Merge the leftovers of a group of partitions: longest first, best fit; the last windows become powers of two."""
    rows = sorted(leftovers.to_pylist(), key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"]))
    packer = Packer((1 << 62) + (rows[0]["source_partition"] // GROUP << 30), length, 1 << 62, min_cut, _crc)
    for r in rows:
        packer.add(r["doc_id"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"], r["start"])
    rest = sorted(packer.windows.held.values(), key=lambda p: -sum(len(x[2]) for x in p))
    poor = []
    for pieces in rest:  # nearly full ones stay whole
        if length - sum(len(x[2]) for x in pieces) < min_cut:
            packer.close(pieces)
        else:
            poor += pieces
    queue, total = poor, sum(len(x[2]) for x in poor)
    while total:  # full sequences, then the powers of two that make up the rest
        room = length if total >= length else 1 << (total.bit_length() - 1)
        total -= room
        taken = []
        while room:
            d, s, i, t = queue.pop(0)
            if len(i) > room:
                queue.insert(0, (d, s + room, i[room:], t))
                i = i[:room]
            taken.append((d, s, i, t))
            room -= len(i)
        packer.close(taken)
    names = [c.split()[0] for c in PIECE.split(", ")]
    return pa.table([pa.array(c, pa.int64()) for c in zip(*packer.out, strict=True)], names=names)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, limit: int = OPEN, min_cut: int = MIN_CUT, end: int = END) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of docs(doc_id, text).

    tokenizer: path of a tokenizers file, readable by every executor.
    """
    prepare(docs.sparkSession)
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(partial(_pack, path=tokenizer, length=length, limit=limit, min_cut=min_cut, end=end), f"{PIECE}, source_partition int, ids binary")
    packed = materialize(packed, "packed")
    names = [c.split()[0] for c in PIECE.split(", ")]
    left = packed.where("ids IS NOT NULL").groupBy(F.expr(f"source_partition div {GROUP}").alias("group")).applyInArrow(lambda t: _merge(t, length, min_cut), PIECE)
    return packed.where("ids IS NULL").select(*names).unionAll(left)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
