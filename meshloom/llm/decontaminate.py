"""Benchmark items inside documents.

Every item is compared with all windows of its own size in words. Both get a 64-bit SimHash over shingles of five words.
Fingerprints of the items of one size are cut into eight blocks of eight bits. Two fingerprints at distance 23 or less
differ by at most two bits in one block, so a table from block values to the items whose block is within two bits finds
them all. What it finds is verified by the exact weighted Jaccard similarity of the two bags of shingles (a shingle weighs
its count). At similarity 0.8 the expected distance is about 10 with a deviation below 3.

Windows are fingerprinted only where enough of their shingles occur in any item for similarity 0.8 to be possible at all:
that bound is exact, and it spares the work on clean text. A document is never shuffled or cut.

The items reach the tasks as a broadcast of bounded size. A benchmark beyond ITEM_BLOCK_WORDS is taken in blocks, one scan of the
documents each: the driver holds one block at a time, and what a block finds is written before its broadcast makes way for
the next.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BASES, WHITE_SPACE_AND_PUNCTUATION, hashed_words, mixed, read_table, rolled, stash

WIDTH = 5
SIMILARITY = 0.8
RADIUS = 23
#: Words of the items in one broadcast: an index of about 100 MB.
ITEM_BLOCK_WORDS = 2_000_000
HITS = "array<struct<item_id: long, similarity: double, start_word: int, n_words: int>>"


def plain_words(texts: list[str | None]) -> list[np.ndarray]:
    """Word hashes of each text, without letter case; punctuation separates like white space."""
    h, counts = hashed_words([(t or "").lower().encode("utf-8", "replace") for t in texts], WHITE_SPACE_AND_PUNCTUATION)
    return np.split(h, np.cumsum(counts)[:-1]) if texts else []


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all windows of five words; of the whole, if there are fewer."""
    return mixed(rolled(words, min(WIDTH, len(words)), BASES[0])) if len(words) else words


def fingerprint_of(bits: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def bits_of(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def similarity(a: Counter, b: Counter) -> float:
    shared = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


_NEAR_BYTE = [[v ^ x for x in range(256) if x.bit_count() <= 2] for v in range(256)]


class ItemIndex:
    def __init__(self, items: Iterable[tuple[int, str]]):
        self.bags, self.prints, self.ids = [], [], []
        self.by_size: dict[int, list[dict[int, list[int]]]] = {}
        every = []
        for item_id, text in items:
            h = plain_words([text])[0]
            if not len(h):
                continue
            s = shingles(h)
            k = len(self.ids)
            self.ids.append(item_id)
            self.bags.append(Counter(s.tolist()))
            self.prints.append(fingerprint_of(bits_of(s).sum(axis=0, dtype=np.int64), len(s)))
            every.append(s)
            tables = self.by_size.setdefault(len(h), [defaultdict(list) for _ in range(8)])
            for block in range(8):
                for value in _NEAR_BYTE[self.prints[k] >> 8 * block & 255]:
                    tables[block][value].append(k)
        self.by_size = {n: [dict(t) for t in tables] for n, tables in self.by_size.items()}
        self.every = np.unique(np.concatenate(every)) if every else np.zeros(0, np.uint64)
        size = max(16, int(len(self.every) * 32).bit_length())
        self.mask = np.uint64((1 << size) - 1)
        self.maybe = np.zeros(1 << size, bool)
        self.maybe[(self.every & self.mask).astype(np.int64)] = True

    def known(self, s: np.ndarray) -> np.ndarray:
        hit = self.maybe[(s & self.mask).astype(np.int64)]
        where = np.nonzero(hit)[0]
        hit[where] = self.every[np.minimum(np.searchsorted(self.every, s[where]), len(self.every) - 1)] == s[where]
        return hit

    def near(self, size: int, fp: int) -> set[int]:
        tables = self.by_size[size]
        found = {k for block in range(8) for k in tables[block].get(fp >> 8 * block & 255, ())}
        return {k for k in found if (self.prints[k] ^ fp).bit_count() <= RADIUS}

    def search(self, words: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of the best window for each item that has one."""
        best: dict[int, tuple[float, int, int]] = {}
        by_width: dict[int, tuple] = {}
        for size in self.by_size:
            n, width = min(size, len(words)), min(WIDTH, size)
            if n < width:
                continue
            if width not in by_width:
                s = mixed(rolled(words, width, BASES[0]))
                known = self.known(s)
                by_width[width] = (s, np.concatenate(([0], np.cumsum(known))) if known.any() else None, [])
            s, counts, bits = by_width[width]
            if counts is None:
                continue
            inside = n - width + 1
            need = SIMILARITY / (1 + SIMILARITY) * (inside + size - width + 1)
            starts = np.nonzero(counts[inside:] - counts[:-inside] >= need - 1e-9)[0]
            if not len(starts):
                continue
            if not bits:
                bits.append(np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(bits_of(s), axis=0, dtype=np.int32))))
            for p in starts.tolist():
                for k in self.near(size, fingerprint_of(bits[0][p + inside] - bits[0][p], inside)):
                    alike = similarity(self.bags[k], Counter(s[p : p + inside].tolist()))
                    if alike >= SIMILARITY and (k not in best or alike > best[k][0]):
                        best[k] = (alike, p, n)
        return sorted((self.ids[k], *x) for k, x in best.items())


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """(items, whether it is the last block); one block, empty, of an empty benchmark. Rows come to the driver partition by partition."""
    block, words = [], 0
    for item_id, text in benchmark.select(F.col(id_col).cast("long"), F.col(text_col)).na.drop().toLocalIterator():
        n = len(text.split())
        if block and words + n > ITEM_BLOCK_WORDS:
            yield block, False
            block, words = [], 0
        block.append((item_id, text))
        words += n
    yield block, True


def hits(index: Broadcast) -> Callable[[Column], Column]:
    """A column of the items found in a text; empty for a null text, an empty one and a clean one."""

    @F.arrow_udf(HITS)
    def found(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("start_word", pa.int32()), ("n_words", pa.int32())]))
        names = ("item_id", "similarity", "start_word", "n_words")
        every = (h for k in range(0, len(texts), 256) for h in plain_words(texts.slice(k, 256).to_pylist()))
        return pa.array([[dict(zip(names, x, strict=True)) for x in index.value.search(h)] for h in every], kind)

    return found


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_words): one row per row of docs and item found in it; the best window.

    Null texts, empty ones and texts shorter than a shingle of the item are in no row; null items and items without words
    are never found. Long texts are searched whole. Repeated rows, of documents or items, each give rows. Other columns are ignored.
    Empty tables give none."""
    found = None
    for items, last in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))
        block = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.explode(hits(index)(F.col(text_col))).alias("hit")).select("doc_id", "hit.*")
        if not last:
            block = stash(block, "hits")
            index.destroy()
        found = block if found is None else found.union(block)
    return found


def without_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, in which no item is found; repeated rows and rows without a text stay."""
    for items, last in item_blocks(benchmark):
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex(items))
        docs = docs.where(F.size(hits(index)(F.col(text_col))) == 0)
        if not last:
            docs = stash(docs, "clean")
            index.destroy()
    return docs


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
