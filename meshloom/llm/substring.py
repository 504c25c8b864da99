"""Removal of word windows that a document with a smaller id has already.

Level-wise doubling. Windows of a quarter of the length (4 words for a window of 13) are looked for first. Where one occurs in two
documents it is extended to twice its length, to the right and to the left (8 words); where one of these does again, once more, to
all that the full windows over the first one cover together (22 words). Where those repeat too, all these full windows are settled
at once, which is the case all through a long passage; so nothing is gained by going on to still longer ones. Only where a window
of the level before has several extensions, at the ends of passages, are the full windows themselves compared, as the last,
partial doubling. It ends as soon as no candidate survives a level.

The first level needn't index every window. In each full window the short window of the least hash is its anchor. Anchors depend
on the words alone, so equal full windows have equal anchors, and a fifth of the positions is enough. Whatever place an anchor
has in a full window, its extension to one of the two sides is inside it too, so no full window is lost on the way. What is decided
is decided by 128 bits of hash.

Groups are never gathered: the least id of a window is an aggregate, and the joins back have one row a key on one side, so
that a hot key is split. Between levels, what is left is written to the shared folder and the shuffle files are freed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASES, forget, hashed_words, id_and_text, mixed, read_table, rolled, stash

WINDOW = 13
#: Documents that are hashed together at most, and the bytes from which on no further one is added.
TOGETHER, TOGETHER_BYTES = 256, 1 << 20


def lengths_of(window: int) -> tuple[int, int]:
    """Words of an anchor and of its extension."""
    short = -(-window // 4)
    return short, min(2 * short, window)


def _sliding_least(h: np.ndarray, width: int) -> np.ndarray:
    out, done = h, 1
    while done < width:
        step = min(done, width - done)
        out = np.minimum(out[:-step], out[step:])
        done += step
    return out


class Windows:
    """The words of some documents in one row, and what is asked about their windows."""

    def __init__(self, ids: list, bodies: list[bytes], window: int):
        self.window = window
        self.short, self.middle = lengths_of(window)
        self.words, counts = hashed_words(bodies)
        ends = np.cumsum(counts)
        self.doc = np.repeat(np.arange(len(bodies)), counts)
        self.begin, self.end = np.repeat(ends - counts, counts), np.repeat(ends, counts)
        self.id = np.array([-1 if x is None else x for x in ids], np.int64)
        known = np.array([x is not None for x in ids], bool)
        n, w = len(self.words), window
        self.full = np.zeros(0, bool)
        if n >= w:
            at = np.arange(n - w + 1)
            self.full = (at + w <= self.end[: n - w + 1]) & known[self.doc[: n - w + 1]]
        self.h = mixed(rolled(self.words, self.short, BASES[0]))

    def anchors(self) -> np.ndarray:
        """Positions of short windows that are the least of a full window; of equal ones all."""
        chosen = np.zeros(len(self.h), bool)
        if len(self.full):
            inside = self.window - self.short + 1
            least = _sliding_least(self.h, inside)
            for o in range(inside):
                chosen[o : o + len(least)] |= self.full & (self.h[o : o + len(least)] == least)
        return np.nonzero(chosen)[0]

    def middles(self, at: np.ndarray) -> list[np.ndarray]:
        """For windows of the middle length: their hashes, and whether they are inside a document."""
        h = mixed(rolled(self.words, self.middle, BASES[0]))
        last = len(h) - 1
        if last < 0 or not len(at):
            return [np.zeros(len(at), np.uint64), np.zeros(len(at), bool)]
        inside = (at >= 0) & (at <= last)
        at = np.clip(at, 0, last)
        inside &= self.doc[at] == self.doc[at + self.middle - 1]
        return [h[at], inside]

    def around(self, at: np.ndarray) -> np.ndarray:
        """Hash of all that the full windows over these anchors cover, inside the document."""
        first, last = np.maximum(self.begin[at], at - (self.window - self.short)), np.minimum(self.end[at], at + self.window)
        base, back = BASES[1], pow(BASES[1], -1, 1 << 64)
        up, down = (np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(len(self.words), b, np.uint64)))) for b in (base, back))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.words * up[:-1], dtype=np.uint64)))
        return mixed((sums[last] - sums[first]) * down[first] + (at - first).astype(np.uint64) * np.uint64(256) + (last - at).astype(np.uint64))

    def over(self, places: list[np.ndarray | None]) -> np.ndarray:
        """Positions of the full windows over the middle windows at these places of each document."""
        marked = np.zeros(len(self.words) + 1, np.int32)
        firsts = np.concatenate(([0], np.cumsum(np.bincount(self.doc, minlength=len(self.id)))))
        inside = self.window - self.middle + 1
        for k, p in enumerate(places):
            if p is not None and len(p):
                at = firsts[k] + np.unique(p)
                np.add.at(marked, np.maximum(at - inside + 1, firsts[k]), 1)
                np.add.at(marked, at + 1, -1)
        return np.nonzero((np.cumsum(marked)[: len(self.full)] > 0) & self.full)[0]

    def place(self, at: np.ndarray) -> np.ndarray:
        return (at - self.begin[at]).astype(np.int32)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        ends, at = np.cumsum(pc.binary_length(whole.column(1)).to_numpy()), 0
        while at < whole.num_rows:
            full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER_BYTES)) + 1
            stop = min(at + TOGETHER, full, whole.num_rows)
            yield whole.slice(at, stop - at)
            at = stop


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _anchor_rows(window: int, more: bool):
    """Anchors; with more, what is around them and their two extensions, null where one would leave its document."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            w = Windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), window)
            at = w.anchors()
            columns, names = [_long(w.h[at]), pa.array(w.id[w.doc[at]])], ["h", "doc_id"]
            if more:
                columns, names = [*columns, pa.array(w.place(at)), _long(w.around(at))], [*names, "pos", "around"]
                for side, start in (("right", at), ("left", at + w.short - w.middle)):
                    h, inside = w.middles(start)
                    if side == "left":
                        # the window to the left begins in the anchor's own document
                        inside = inside & (start >= w.begin[at]) if len(at) else inside
                    columns, names = [*columns, pa.array(h.view(np.int64), mask=~inside)], [*names, side]
            yield pa.record_batch(columns, names=names)

    return rows


def _full_rows(window: int):
    """The full windows over the given middle windows: two hashes, id and first word of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _chunks(batches):
            w = Windows(batch.column(0).to_pylist(), batch.column(1).to_pylist(), window)
            at = w.over([p.values.to_numpy() if p.is_valid else None for p in batch.column(2)])
            a, b = (mixed(rolled(w.words, window, base))[at] for base in BASES)
            yield pa.record_batch([_long(a), _long(b), pa.array(w.id[w.doc[at]]), pa.array(w.place(at))], names=["h1", "h2", "doc_id", "first"])

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        n_words, n_removed, kept = [], [], []
        for body, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            words = body.split()
            n_words.append(len(words))
            if ranges.is_valid:
                gone = np.zeros(len(words) + 1, np.int32)
                both = ranges.values
                np.add.at(gone, np.clip(both.field(0).to_numpy(), 0, len(words)), 1)
                np.add.at(gone, np.clip(both.field(1).to_numpy(), 0, len(words)), -1)
                words = list(compress(words, (np.cumsum(gone)[:-1] == 0).tolist()))
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ranges array<struct<first: int, last: int>>): words, last exclusive, that are covered by windows whose word
    sequence also starts in a document with a smaller id. A range may reach over the ends of its document."""
    texts = id_and_text(docs, id_col, text_col)
    least_most = [F.min("doc_id").alias("least"), F.max("doc_id").alias("most")]
    short, middle = lengths_of(window)
    repeated = lambda windows: windows.groupBy("h").agg(*least_most).where("least < most").select("h")
    nothing = docs.sparkSession.createDataFrame([], "doc_id long, ranges array<struct<first: int, last: int>>")

    # first level: short windows; those that survive come with their extensions
    shared = stash(repeated(texts.mapInArrow(_anchor_rows(window, False), "h long, doc_id long")), "short")
    if shared.isEmpty():
        return nothing
    extended = texts.mapInArrow(_anchor_rows(window, True), "h long, doc_id long, pos int, around long, right long, left long")
    alive = stash(extended.join(shared, "h").drop("h"), "anchors")
    forget(shared)

    # second level: twice as long, to both sides; the anchor begins `lead` words after it
    sides = F.array(F.struct(F.col("right").alias("h"), "pos", F.lit(0).cast("byte").alias("lead")), F.struct(F.col("left").alias("h"), (F.col("pos") + short - middle).alias("pos"), F.lit(middle - short).cast("byte").alias("lead")))
    doubled = alive.select("doc_id", "around", F.explode(sides).alias("w")).select("doc_id", "around", "w.*").where("h is not null")
    # written first, so that a join has a plain exchange on both sides, which can be split where a key is hot
    shared = stash(repeated(doubled), "middle")
    found = stash(doubled.join(shared, "h"), "doubled")
    forget(alive)
    forget(shared)
    if found.isEmpty():
        return nothing

    # third level: more than twice as long, all full windows over the anchor, which settles them at once
    first = stash(found.groupBy("h", "around").agg(*least_most), "first")
    begin = F.col("pos") + F.col("lead") - (window - short)
    settled = stash(found.join(first.where("least < most"), ["h", "around"]).where("least < doc_id").select("doc_id", begin.alias("first"), (begin + 2 * window - short).alias("last")), "settled")

    # a window stays open in the first document of each of its extensions, if it has several, in several documents
    several = first.groupBy("h").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a < b").select("h")
    open_ = first.join(several, "h").select("h", "around", "least")
    places = stash(found.join(open_, ["h", "around"]).where("doc_id = least").groupBy("doc_id").agg(F.collect_set("pos").alias("places")), "open")
    forget(found)
    full = stash(texts.join(places, "doc_id").select("doc_id", "body", "places").mapInArrow(_full_rows(window), "h1 long, h2 long, doc_id long, first int"), "windows")
    earliest = full.groupBy("h1", "h2").agg(*least_most).where("least < most").select("h1", "h2", "least")
    later = full.join(earliest, ["h1", "h2"]).where("least < doc_id").select("doc_id", "first", (F.col("first") + window).alias("last"))
    ranges = stash(settled.union(later).distinct().groupBy("doc_id").agg(F.collect_list(F.struct("first", "last")).alias("ranges")), "ranges")
    for df in (first, settled, places, full):
        forget(df)
    return ranges


def remove_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept (bytes: the words that stay, joined by single spaces).

    A word goes if a window of `window` words over it also starts in a row with a smaller doc_id. A null text has no
    words; texts shorter than the window, empty ones and rows with a null doc_id lose nothing. Rows with one doc_id don't
    count against each other; each is cut at the windows that a smaller id has (rows that differ under one id: at all
    such windows of that id). Other columns are ignored. An empty table gives no rows."""
    ranges = repeated_ranges(docs, window, id_col, text_col)
    return id_and_text(docs, id_col, text_col).join(ranges, "doc_id", "left").select("doc_id", "body", "ranges").mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept binary")


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


