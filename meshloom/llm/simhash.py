"""Near-duplicate groups of documents by SimHash, searched through deletion variants of two segments.

Two 64-bit fingerprints at distance 2 or less, cut into two segments of 32 bits, differ by at most one bit in one
of them. So they share a one-wildcard variant: that segment with one bit deleted. Every distinct fingerprint is
indexed under its 2 x 32 variants; an equality join of those brings all close pairs together and the popcount of
their XOR verifies them.

Buckets of many fingerprints aren't paired. Their fingerprints are indexed a second time, under all 2016 forms with
two bits deleted. Fingerprints that share such a form are at most two bits apart, so no verification is needed, and
at most four distinct ones can share it. This costs a constant number of rows per fingerprint, however large the
bucket is, and loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import forget, id_and_text, stash, unused
from .components import components

#: Distinct fingerprints in a bucket that are still compared pair by pair. A compared pair is several times cheaper
#: than one of the 2016 shuffled rows of the other way, so the two cost about the same near this size.
PAIRED_BUCKET = 128


def fingerprint(body: bytes, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over shingles of `width` words with repeats; zero for a text without words."""
    import xxhash

    words = body.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        h = np.array([xxhash.xxh64_intdigest(joined, seed)], dtype=np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        n = len(words) - width + 1
        h = np.fromiter((digest(joined[s:e], seed) for s, e in zip(starts[:n].tolist(), ends[width - 1 :].tolist(), strict=True)), dtype=np.uint64, count=n)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 65_536):
        ones += np.unpackbits(h[k : k + 65_536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.release()
    for batch in batches:
        found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        names = batch.schema.names
        yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]], names=[names[0], "fp", *names[2:]])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per input row; the scan reads two columns and nothing is shuffled."""
    return id_and_text(docs, id_col, text_col).mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame) -> DataFrame:
    """fps (fp), distinct -> (a, b): edges that connect whatever fingerprints of at most two differing bits connect."""
    low = F.lit(0xFFFFFFFF)
    # 64 rows come of each, so they are dealt out before
    spread = _dealt(fps, 10_000).select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("i"))
    variants = spread.select(
        "fp",
        F.expr("shiftrightunsigned(fp, i & 32)").bitwiseAND(low).bitwiseAND(F.expr("~shiftleft(1L, i & 31)")).bitwiseOR(F.expr("shiftleft(cast(i as long), 32)")).alias("variant"),
    )
    shared = stash(variants.groupBy("variant").agg(F.min("fp").alias("a"), F.max("fp").alias("b")).where("a <> b").select("variant"), "shared")
    # who is in a shared bucket: its deleted bit has two values, so two whole segments lead to it; 2 rows a fingerprint, not 64
    deleted = F.expr("shiftleft(1L, cast(shiftright(variant, 32) as int) & 31)")
    whole = shared.select("variant", F.expr("cast(shiftright(variant, 37) as int)").alias("s"), F.col("variant").bitwiseAND(low).alias("masked"))
    doors = whole.select("variant", "s", F.explode(F.array(F.col("masked"), F.col("masked").bitwiseOR(deleted))).alias("segment"))
    segments = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("s")).select("fp", "s", F.expr("shiftrightunsigned(fp, s * 32) & 4294967295").alias("segment"))
    members = stash(doors.join(segments, ["s", "segment"]).select("variant", "fp"), "members")

    sizes = members.groupBy("variant").agg(F.count("*").alias("n"))
    few = members.join(sizes.where(f"n <= {PAIRED_BUCKET}"), "variant")
    left, right = few.select("variant", F.col("fp").alias("a")), members.select(F.col("variant").alias("same"), F.col("fp").alias("b"))
    # a pair with an equal segment meets under all 32 deletions of it; the first one alone reports it
    differs = F.expr("shiftrightunsigned(a ^ b, cast(shiftright(variant, 32) as int) & 32) & 4294967295")
    met = (F.col("variant") == F.col("same")) & F.expr("a < b and bit_count(a ^ b) <= 2") & ((differs == deleted) | ((differs == 0) & (deleted == 1)))
    crowded = members.join(sizes.where(f"n > {PAIRED_BUCKET}").select("variant"), "variant").select("fp").distinct()
    return left.join(right, met).select("a", "b").union(_two_deleted(stash(crowded, "crowded"))).distinct()


def _dealt(fps: DataFrame, rows: int) -> DataFrame:
    """fps (fp) in partitions of about so many rows. With a number given, adaptive execution doesn't put them together again."""
    return fps.repartition(min(100_000, 1 + fps.count() // rows), "fp")


def _two_deleted(fps: DataFrame) -> DataFrame:
    """Edges among fingerprints by the forms with bits i < j deleted; at most four fingerprints share a form."""
    forms = (
        _dealt(fps, 500)
        .select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
        .select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
        .select("fp", F.expr("i * 64 + j").alias("ij"), F.expr("fp & ~(shiftleft(1L, i) | shiftleft(1L, j))").alias("form"))
    )
    met = forms.groupBy("ij", "form").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.expr("bit_xor(fp)").alias("x")).where("n > 1")
    third = F.expr("x ^ a ^ b")  # with three members
    one = F.expr("form | shiftleft(1L, cast(ij div 64 as int))")
    two = F.expr("form | shiftleft(1L, ij % 64)")
    four = F.array(F.struct(F.col("form").alias("a"), one.alias("b")), F.struct(F.col("form").alias("a"), two.alias("b")), F.struct(one.alias("a"), F.expr("form | shiftleft(1L, cast(ij div 64 as int)) | shiftleft(1L, ij % 64)").alias("b")))
    edges = F.when(F.col("n") == 2, F.array(F.struct("a", "b"))).when(F.col("n") == 3, F.array(F.struct("a", "b"), F.struct("a", third.alias("b")))).otherwise(four)
    return met.select(F.explode(edges).alias("e")).select("e.a", "e.b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    A null text counts as empty; texts without words all have fingerprint zero and so are one class. Repeated rows and
    ties get the same class. A null doc_id gets a row, but never names a class unless its whole class has none. Other
    columns are ignored. An empty table gives no rows."""
    fps = stash(fingerprints(docs, id_col, text_col), "fps")
    return _grouped(fps).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _grouped(fps: DataFrame) -> DataFrame:
    """fps, stashed, with doc_id and fp -> + component (a fingerprint of the group, its number) and component_id."""
    classes = stash(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    reached = components(edges := stash(links(classes.select("fp")), "links"))
    forget(edges)
    # the component's name is a fingerprint; what is asked for is the smallest doc_id of its classes
    named = reached.join(classes, reached.node == classes.fp).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_fp = stash(reached.join(named, "component").select(F.col("node").alias("fp"), "component", "component_id"), "of_fp")
    least = classes.join(of_fp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return fps.join(least, "fp")


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: of each group one row with its smallest doc_id.

    A row is known by its doc_id and a 128-bit digest of its text, so different texts of one doc_id are in groups of their own. Of
    several rows of a group with that doc_id the one of the least digests of its text and of all its columns stays. Rows with a
    null doc_id can't be told apart and all stay. An empty table stays empty."""
    own, h1, h2, row = unused(docs.columns, "own", "h1", "h2", "row")
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({own: F.col(id_col).cast("long"), h1: F.xxhash64(text), h2: F.xxhash64(text, F.lit(1))})
    bodies = keyed.select(F.col(own).alias("doc_id"), F.encode(text, "UTF-8").alias("body"), F.col(h1).alias("h1"), F.col(h2).alias("h2"))
    fps = stash(bodies.mapInArrow(_fingerprints, "doc_id long, fp long, h1 long, h2 long"), "fps")
    first = _grouped(fps).where("doc_id = component_id").groupBy("component", "component_id").agg(F.min(F.struct("h1", "h2")).alias("h"), F.count("*").alias("n"))
    stays = stash(first.select(F.col("component_id").alias(own), F.col("h.h1").alias(h1), F.col("h.h2").alias(h2), "n"), "stays")
    # what stays grows with the documents, so it is never broadcast, however small it may be here
    kept = keyed.join(stays.drop("n").hint("merge"), [own, h1, h2], "left_semi")
    if stays.where("n > 1").limit(1).count():
        hashed = [c for c, t in docs.dtypes if "map<" not in t]
        kept = kept.withColumn(row, F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
        least = kept.groupBy(own, h1, h2).agg(F.min(row).alias(row))
        kept = kept.join(least.hint("merge"), [own, h1, h2, row], "left_semi").dropDuplicates([own, h1, h2])
    return kept.select(*docs.columns).unionByName(docs.where(F.col(id_col).isNull()))


def op10_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return near_duplicates(read_table(spark, sf_dir, "documents"))
