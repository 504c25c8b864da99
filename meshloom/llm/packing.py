"""Packing of tokenized documents into training sequences of several lengths.

Hierarchical multi-length packing, inside each task of the scan, so nothing is shuffled and a lost task repeats the same
result. Documents are routed by length to the tiers 128, 256, 512 and 1024; full windows of the longest tier are cut off
first. Each tier is packed from the longest down: a window begins with the longest document left in its tier, its gap is
filled with the longest documents of it and the shorter tiers that fit, and, where none fits, with the head of the
shortest one, whose rest goes back to the tier of its length. So windows have no padding. What a task has left at its
end, less than a window, is cut into powers of two. Windows of one tier form step groups of equal token counts.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import read_table
from .tokens import encoder

TIERS = (128, 256, 512, 1024)
#: Tokens that wait in a task to be packed together.
POOL_TOKENS = 1_000_000
#: Tokens in a step group.
STEP_TOKENS = 65_536

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Pieces are (length, serial, doc, start, ids, total). add() and close() return finished rows."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS):
        self.tiers, self.task, self.serial, self.next, self.pool, self.waiting = sorted(tiers), task, 0, 0, [], 0
        self.in_step: dict[int, int] = defaultdict(int)
        self.step: dict[int, int] = {}
        self.steps = 0

    def window(self, pieces: list[tuple]) -> list[tuple]:
        size, offset, rows = sum(p[0] for p in pieces), 0, []
        if size not in self.step or self.in_step[size] + size > STEP_TOKENS:
            self.step[size], self.in_step[size] = self.steps, 0
            self.steps += 1
        self.in_step[size] += size
        for length, _, doc, start, ids, total in pieces:
            rows.append((doc, start, length, ids, total, self.task << 33 | self.next, offset, size, self.task << 33 | self.step[size]))
            offset += length
        self.next += 1
        return rows

    def wait(self, piece: tuple) -> None:
        bisect.insort(self.pool, piece)
        self.waiting += piece[0]

    def take(self, k: int) -> tuple:
        piece = self.pool.pop(k)
        self.waiting -= piece[0]
        return piece

    def add(self, doc: int | None, ids: bytes) -> list[tuple]:
        total, top, rows = len(ids) // 4, self.tiers[-1], []
        for start in range(0, total, top):
            length, part = min(top, total - start), ids[4 * start : 4 * (start + top)]
            self.serial += 1
            piece = (length, self.serial, doc, start, part, total)
            if length == top:
                rows += self.window([piece])
            else:
                self.wait(piece)
        if self.waiting > POOL_TOKENS:
            while self.waiting > POOL_TOKENS // 4:
                rows += self.fill()
        return rows

    def fill(self) -> list[tuple]:
        """One full window, of the tier of the longest piece that waits; all tiers below it fill its gap."""
        pieces = [self.take(-1)]
        size = next(t for t in self.tiers if t >= pieces[0][0])
        gap = size - pieces[0][0]
        while gap:
            k = bisect.bisect_right(self.pool, (gap, float("inf")))
            if k:
                pieces.append(self.take(k - 1))
                gap -= pieces[-1][0]
                continue
            length, serial, doc, start, ids, total = self.take(0)
            pieces.append((gap, serial, doc, start, ids[: 4 * gap], total))
            self.wait((length - gap, serial, doc, start + gap, ids[4 * gap :], total))
            gap = 0
        return self.window(pieces)

    def close(self) -> list[tuple]:
        rows = []
        while self.pool and self.waiting >= next(t for t in self.tiers if t >= self.pool[-1][0]):
            rows += self.fill()
        while self.pool:
            size = 1 << (self.waiting.bit_length() - 1)
            pieces, gap = [], size
            while gap:
                length, serial, doc, start, ids, total = self.take(-1)
                used = min(gap, length)
                pieces.append((used, serial, doc, start, ids[: 4 * used], total))
                if used < length:
                    self.wait((length - used, serial, doc, start + used, ids[4 * used :], total))
                gap -= used
            rows += self.window(pieces)
        return rows


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def _pack(tokenizer: str, end_id: int, tiers: tuple[int, ...]):
    end = np.array([end_id], "<u4").tobytes()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, packer = encoder(tokenizer), Packer(TaskContext.get().partitionId(), tiers)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch, out = whole.slice(at, 1024), []
                ids, bounds = model.column(batch.column(1))
                raw, bounds = ids.astype("<u4").tobytes(), (4 * bounds).tolist()
                for k, doc in enumerate(batch.column(0).to_pylist()):
                    out += packer.add(doc, raw[bounds[k] : bounds[k + 1]] + end)
                if out:
                    yield _table(out)
        if out := packer.close():
            yield _table(out)

    return rows


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, tiers: tuple[int, ...] = TIERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, tier (tokens in the sequence: a tier, or a power of two at the end of a task), step_group.

    Every id of every row lies in one piece. A null text counts as empty: its only id is the end. A null doc_id stays null.
    Repeated rows are packed each for itself. Long texts are cut. Other columns are ignored. An empty table gives no rows."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(_pack(tokenizer, end_id, tiers), SCHEMA)


def pieces(docs: DataFrame) -> DataFrame:
    return pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pieces(read_table(spark, sf_dir, "documents"))
