"""Near-duplicate vectors inside each label, by exact cosine over PCA-ordered tiles.

Equal vectors are one class with a count. Class vectors are normed and rotated into the principal axes of a bounded
sample (any rotation keeps cosines, so the sample affects speed alone), which puts most of a product into the leading
dimensions. Classes are sorted by label and along the first axis, over range partitions, and cut into tiles as they come; tiles
that meet in a band of the first axis, and whose bounding boxes in the first axes are no farther apart than the threshold allows,
are compared. A tile pair is compared by accumulating the
leading dimensions first and bounding the rest of each product by the norms of the suffixes; it stops when no pair can
still reach the threshold, and goes on for the open pairs alone when they are few. What remains is decided by the cosine of the original vectors in
double precision.

A tile pair reports the number of links of each vector and a spanning forest of its links, never the links themselves,
so a group of n near copies costs rows in proportion to n and not to its square.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, read_table, stash
from .components import components

THRESHOLD = 0.93
TILE = 1024
#: Vectors from which the axes are fitted.
SAMPLE = 20_000
#: Axes in the bounding boxes, and where the accumulation looks whether a pair can still reach the threshold.
BOX, STEPS = 4, (8, 16, 32)
SLACK = 1e-9


def axes_of(sample: np.ndarray) -> np.ndarray:
    """Columns are orthonormal; the second moment of the normed vectors decreases along them."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()


def _normed(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # no overflow in the norm
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _rotated(unit: np.ndarray, axes: np.ndarray | None) -> np.ndarray:
    return unit @ axes if axes is not None and unit.shape[1] == len(axes) else unit


def linked(a: np.ndarray, b: np.ndarray, za: np.ndarray, zb: np.ndarray, threshold: float) -> np.ndarray:
    """Boolean matrix: cosine of the original unit vectors a and b >= threshold. za, zb: the rotated ones."""
    d = za.shape[1]
    sums, done = np.zeros((len(za), len(zb))), 0
    for step in [s for s in STEPS if s < d] + [d]:
        sums += za[:, done:step] @ zb[:, done:step].T
        done = step
        rest = np.linalg.norm(za[:, done:], axis=1)[:, None] * np.linalg.norm(zb[:, done:], axis=1)[None, :]
        open_ = sums + rest >= threshold - SLACK
        n = int(open_.sum())
        if not n:
            return open_
        if n * 20 < open_.size or done == d:
            break
    i, j = np.nonzero(open_)
    for at in range(0, len(i), 65_536):
        p, q = i[at : at + 65_536], j[at : at + 65_536]
        open_[p, q] = np.einsum("ij,ij->i", a[p], b[q]) >= threshold
    return open_


def forest(links: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Edges (row, column) that connect whatever the links connect, at most rows + columns of them."""
    n, m = links.shape
    if same:
        m = 0
        links = links | links.T
    left_done, right_done = np.zeros(n, bool), np.zeros(links.shape[1], bool)
    edges: list[tuple[int, int]] = []
    for root in range(n):
        if left_done[root]:
            continue
        left_done[root] = True
        if same:
            right_done[root] = True
        stack = [root]
        while stack:
            row = stack.pop()
            new = np.nonzero(links[row] & ~right_done)[0]
            right_done[new] = True
            edges += [(row, int(c)) for c in new]
            if same:
                left_done[new] = True
                stack += new.tolist()
                continue
            for c in new.tolist():
                rows = np.nonzero(links[:, c] & ~left_done)[0]
                left_done[rows] = True
                edges += [(int(r), c) for r in rows]
                stack += rows.tolist()
    return edges


def _project(axes: np.ndarray | None):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = []
            for v in batch.column(3).to_pylist():
                z = _rotated(_normed(np.array([v], np.float64)), axes)[0][:BOX]
                box.append([*z.tolist(), *[0.0] * (BOX - len(z))])
            yield pa.record_batch([*batch.columns, pa.array(box, pa.list_(pa.float64()))], names=["vec_id", "n", "label", "embedding", "dim", "box"])

    return rows


def _tiles(size: int):
    """From sorted rows (label, dim, vec_id, n, embedding, box): stretches of one label and dim, up to `size` rows each, with the box
    around them. Rows are numbered from the task's own number on; a tile has the number of its first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        now, n, first = None, 0, TaskContext.get().partitionId() << 33

        def table() -> pa.RecordBatch:
            whole = pa.concat_batches(held)
            box = np.array(whole.column(5).flatten()).reshape(-1, BOX)
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            ends = [pa.array([float(x)]) for k in range(BOX) for x in (box[:, k].min(), box[:, k].max())]
            columns = [whole.column(0).slice(0, 1), whole.column(1).slice(0, 1), pa.array([first], pa.int64()), one(whole.column(2)), one(whole.column(3)), one(whole.column(4)), *ends]
            return pa.record_batch(columns, names=["label", "dim", "tile", "ids", "counts", "vectors", *[f"{e}{k}" for k in range(BOX) for e in ("lo", "hi")]])

        for batch in batches:
            keys, at = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)), 0
            while at < batch.num_rows:
                if held and (keys[at] != now or n == size):
                    yield table()
                    held, n, first = [], 0, first + n
                now, stop = keys[at], at
                while stop < batch.num_rows and keys[stop] == now and n + stop - at < size:
                    stop += 1
                held.append(batch.slice(at, stop - at))
                n, at = n + stop - at, stop
        if held:
            yield table()

    return rows


def _compare(axes: np.ndarray | None, threshold: float):
    def vectors(column: pa.Array) -> np.ndarray:
        return np.array(column.as_py(), np.float64)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(0)[k].as_py()
                n_a, n_b = (np.array(batch.column(c)[k].as_py(), np.int64) for c in (2, 5))
                a, b = _normed(vectors(batch.column(3)[k])), _normed(vectors(batch.column(6)[k]))
                ids_a, ids_b = (batch.column(c)[k].as_py() + np.arange(len(n), dtype=np.int64) for c, n in ((1, n_a), (4, n_b)))
                links = linked(a, b, _rotated(a, axes), _rotated(b, axes), threshold)
                if same:
                    np.fill_diagonal(links, False)
                edges = forest(links, same)
                if not edges:
                    continue
                totals = [(int(x), int(t)) for x, t in zip(ids_a, links @ n_b, strict=True) if t]
                if not same:
                    totals += [(int(x), int(t)) for x, t in zip(ids_b, n_a @ links, strict=True) if t]
                x, y = [t[0] for t in totals], [None] * len(totals)
                n = [t[1] for t in totals]
                x += [int(ids_a[e[0]]) for e in edges]
                y += [int((ids_a if same else ids_b)[e[1]]) for e in edges]
                n += [0] * len(edges)
                yield pa.record_batch([pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64())], names=["a", "b", "n"])

    return rows


def near_vectors(table: DataFrame, threshold: float = THRESHOLD, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors link if their labels are equal and not null, their lengths are equal and their cosine is at least the threshold.
    A null vector, an empty or zero one, and one with null or infinite components or NaN has no links. Equal vectors of one
    label link with each other; n_links counts all other rows, repeated ones of the same id too. A row without an id has links like
    any other, but names a component only if no row in it has an id. Long vectors are compared whole. Other columns are ignored. An
    empty table gives no rows."""
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit_for = F.col("label").isNotNull() & F.coalesce((F.size("embedding") > 0) & F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = rows.select("vec_id", "label", F.when(fit_for, F.col("embedding")).alias("embedding"))
    # a class is one vector of one label; its rows may have any ids, or none
    classes = stash(rows.where("embedding is not null").groupBy("label", "embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n")).select("vec_id", "n", "label", "embedding", F.size("embedding").alias("dim")), "vectors")
    some = [r[0] for r in classes.select("embedding").limit(SAMPLE).collect()]  # bounded: SAMPLE vectors
    dims = max({len(v) for v in some}, key=lambda d: sum(len(v) == d for v in some)) if some else 0
    axes = axes_of(np.array([v for v in some if len(v) == dims])) if some else None
    placed = stash(classes.mapInArrow(_project(axes), "vec_id long, n long, label " + classes.schema["label"].dataType.simpleString() + ", embedding array<double>, dim int, box array<double>"), "placed")

    # tiles are stretches of the order along the first axis, inside a label; ties follow the id, so that equal places are dealt out too
    order = ["label", "dim", "first", "vec_id"]
    parts = 1 + placed.count() // (8 * tile)
    along = placed.withColumn("first", F.col("box")[0]).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    label_type = classes.schema["label"].dataType.simpleString()
    tiles = stash(along.select("label", "dim", "vec_id", "n", "embedding", "box").mapInArrow(_tiles(tile), f"label {label_type}, dim int, tile long, ids array<long>, counts array<long>, vectors array<array<double>>, " + ", ".join(f"{e}{k} double" for k in range(BOX) for e in ("lo", "hi"))), "tiles")

    # tiles meet in bands of the first axis as wide as near vectors can be apart: a pair is told by the first band that both reach
    width = math.sqrt(2 - 2 * threshold) + SLACK
    box = ["label", "dim", "tile", *[f"{e}{k}" for k in range(BOX) for e in ("lo", "hi")]]
    band = lambda x: F.floor(x / width)
    a = tiles.select(*box).withColumn("first_band", band(F.col("lo0"))).withColumn("band", F.explode(F.sequence(F.col("first_band"), band(F.col("hi0")) + 1)))
    b = tiles.select(*[F.col(c).alias(c if c in ("label", "dim") else f"{c}_b") for c in box]).withColumn("first_band_b", band(F.col("lo0_b"))).withColumn("band", F.explode(F.sequence(F.col("first_band_b"), band(F.col("hi0_b")) + 1)))
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"lo{k}") - F.col(f"hi{k}_b"), F.col(f"lo{k}_b") - F.col(f"hi{k}")), 2) for k in range(BOX))
    near = a.join(b, ["label", "dim", "band"]).where((F.col("tile") <= F.col("tile_b")) & (F.col("band") == F.greatest("first_band", "first_band_b")) & (gap <= 2 - 2 * threshold + SLACK)).select("tile", "tile_b")
    load = lambda s: tiles.select(F.col("tile").alias(f"tile{s}"), F.col("counts").alias(f"counts{s or '_a'}"), F.col("vectors").alias(f"vectors{s or '_a'}"))
    pairs = near.join(load(""), "tile").join(load("_b"), "tile_b").withColumn("same", F.col("tile") == F.col("tile_b"))
    # Spark bounds the bytes of a batch, and a row, which is two tiles, is worked off alone
    found = stash(pairs.select("same", "tile", "counts_a", "vectors_a", "tile_b", "counts_b", "vectors_b").mapInArrow(_compare(axes, threshold), "a long, b long, n long"), "found")

    others = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    reached = components(found.where("b is not null").select("a", "b"))
    each = tiles.select("tile", "label", F.posexplode(F.arrays_zip("ids", "counts", "vectors")).alias("place", "m")).select((F.col("tile") + F.col("place")).alias("node"), "label", F.col("m.ids").alias("vec_id"), F.col("m.counts").alias("n"), F.col("m.vectors").alias("embedding"))
    whole = each.join(others, "node", "left").join(reached, "node", "left")
    whole = stash(whole.select("label", "embedding", "vec_id", "component", (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links")), "linked")
    # a component's number is a vector's; what is asked for is the smallest id in it
    named = whole.where("component is not null").groupBy("component").agg(F.min("vec_id").alias("name"))
    of_class = whole.join(named, "component", "left").select("label", "embedding", "links", F.coalesce("name", "vec_id").alias("name"))
    forget(found)
    forget(tiles)
    forget(placed)
    joined = rows.join(of_class, ["label", "embedding"], "left")
    component = F.coalesce("name", "vec_id")
    return joined.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))


def op6_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))
