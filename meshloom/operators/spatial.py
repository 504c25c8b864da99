"""Distance joins by grid cells: an equality join on cells, then the exact test. A plain range predicate would compare all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .tables import settle

#: Doublings of the cells before the nearest of what is still alone is sought among all.
ROUNDS = 12


def _cell(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def distance_join(left: DataFrame, right: DataFrame, radius: Column, size: Column) -> DataFrame:
    """Pairs with equal mesh_id and distance <= radius (a Column over left's and right's columns, at most `size`, which is a
    Column over either side's columns, constant in a mesh).

    left has x, y, z and is repeated for the 27 cells around; right has rx, ry, rz and stays in its own. size must be positive."""
    around = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]
    spread = left.withColumn("__d", F.explode(F.array(*around)))
    for axis, d in zip("xyz", "ijk", strict=True):
        spread = spread.withColumn(f"__{axis}", _cell(F.col(axis), size) + F.col("__d")[d])
    placed = right
    for axis in "xyz":
        placed = placed.withColumn(f"__{axis}", _cell(F.col(f"r{axis}"), size))
    keys = ["mesh_id", "__x", "__y", "__z"]
    size_free = placed.drop(*[c for c in placed.columns if c in spread.columns and c not in keys])
    far = g.length(g.sub(g.point(""), g.point("r")))
    return spread.join(size_free, keys).where(far <= radius).withColumn("distance", far).drop("__d", "__x", "__y", "__z")


def _sizes(left: DataFrame, right: DataFrame) -> DataFrame:
    """(mesh_id, __size): cells of a few right points each where these are dense; positive, and not too small to number the cells."""
    middle = F.greatest(*[F.percentile_approx(f"r{a}", 0.75) - F.percentile_approx(f"r{a}", 0.25) for a in "xyz"])
    inner = right.groupBy("mesh_id").agg((2 * middle / F.cbrt(F.count("*"))).alias("inner"))
    points = left.select("mesh_id", "x", "y", "z").union(right.select("mesh_id", "rx", "ry", "rz"))
    outer = points.groupBy("mesh_id").agg(F.max(F.greatest(*[F.abs(a) for a in "xyz"])).alias("outer"))
    size = F.greatest(F.col("inner"), F.col("outer") * 1e-9)
    return inner.join(outer, "mesh_id").select("mesh_id", F.when(size > 0, size).otherwise(1.0).alias("__size"))


def nearest(left: DataFrame, right: DataFrame, left_id: str, right_id: str, others: bool = False) -> DataFrame:
    """For each left row (mesh_id, left_id, x, y, z) the nearest right row (mesh_id, right_id, rx, ry, rz), ties to the
    smallest id; with others, only right rows of another id than the left one's.

    Ids are unique in a mesh. What is compared are places, so copies cost nothing: of right rows at one place only the two
    smallest ids can be an answer, and left rows at one place share their nearest one (two with others). Those are sought in
    the cells around; places with too few within a cell's size go on to cells of twice the size, and the few that are still
    alone after ROUNDS are compared with all. A left row without a right one, or with a null or NaN coordinate, gives no row."""
    known = lambda df, p: df.where(" and ".join(f"{p}{a} is not null and not isnan({p}{a})" for a in "xyz"))
    place, most = ["mesh_id", "x", "y", "z"], 2 if others else 1
    left = settle(known(left.select(*place, left_id), ""))
    ids = Window.partitionBy("mesh_id", "rx", "ry", "rz").orderBy(right_id)
    right = settle(known(right.select("mesh_id", right_id, "rx", "ry", "rz"), "r").withColumn("__k", F.row_number().over(ids)).where("__k <= 2").drop("__k"))
    # one row of two numbers a mesh; left rows of a mesh without right ones go here
    sizes = F.broadcast(settle(_sizes(left, right)))
    alone, right = settle(left.select(*place).distinct().join(sizes, "mesh_id")), settle(right.join(sizes, "mesh_id"))
    far = g.length(g.sub(g.point(""), g.point("r")))
    rank = Window.partitionBy(*place).orderBy("distance", right_id)

    def best(pairs: DataFrame, enough: int) -> DataFrame:
        first = pairs.select(*place, "distance", right_id).withColumn("__k", F.row_number().over(rank)).where(F.col("__k") <= most)
        return settle(first.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("distance", right_id))).alias("__best")).where(F.size("__best") >= enough))

    found = None
    for k in range(ROUNDS):
        size = F.col("__size") * 2.0**k
        # a little less than a cell, so that rounding in the numbers of the cells loses nothing
        some = best(distance_join(alone, right, size * 0.99, size), most)
        found = some if found is None else found.union(some)
        alone = settle(alone.join(some.hint("merge"), place, "left_anti"))
        if alone.isEmpty():
            break
    else:
        found = found.union(best(alone.drop("__size").join(right, "mesh_id").withColumn("distance", far), 1))
    first, second = F.get("__best", F.lit(0)), F.get("__best", F.lit(1))
    mine = F.when(first[right_id].eqNullSafe(F.col(left_id)), second).otherwise(first) if others else first
    answer = left.join(settle(found).hint("merge"), place).select("mesh_id", left_id, mine.alias("__mine"))
    return settle(answer).where("__mine is not null").select("mesh_id", left_id, F.col("__mine")[right_id].alias(right_id), F.col("__mine")["distance"].alias("distance"))


def box_overlaps(boxes: DataFrame, threshold: float) -> DataFrame:
    """boxes (mesh_id, piece, lo{x,y,z}, hi{x,y,z}) -> (mesh_id, piece_a, piece_b): a != b whose boxes meet when only a's is
    grown by threshold. Pieces of a mesh are few; the join is by mesh_id."""
    b = boxes.select("mesh_id", F.col("piece").alias("piece_b"), *[F.col(f"{e}{k}").alias(f"{e}{k}_b") for k in "xyz" for e in ("lo", "hi")])
    meet = F.lit(True)
    for k in "xyz":
        meet = meet & (F.col(f"lo{k}") - threshold <= F.col(f"hi{k}_b")) & (F.col(f"lo{k}_b") <= F.col(f"hi{k}") + threshold)
    return boxes.withColumnRenamed("piece", "piece_a").join(b, "mesh_id").where((F.col("piece_a") != F.col("piece_b")) & meet)
