"""Wavefront OBJ as a source: text lines to mesh relations, by windows over the lines of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import Mesh


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(mesh_id, line, value): the lines of every file, numbered; files are numbered by their paths."""
    files = spark.read.text(path, wholetext=True).withColumn("file", F.input_file_name())
    ids = files.select("file").distinct().withColumn("mesh_id", F.row_number().over(Window.orderBy("file")).cast("long") - 1)
    return files.join(ids, "file").select("mesh_id", F.posexplode(F.split("value", "\n")).alias("line", "value"))


def parse(lines: DataFrame) -> Mesh:
    """lines (mesh_id, line, value). Tags v, vt, vn, usemtl and f count; all others, blank lines and comments don't.

    Indices start at 1; negative ones count back from the elements seen so far. A missing index of a corner is null, and a
    mesh in which no corner has one has null instead of the array. Materials are numbered by their first use in the file; faces
    before any are material 0. A face that isn't a triangle is an error."""
    rows = lines.withColumn("value", F.trim(F.regexp_replace("value", r"[\s]+", " "))).where((F.col("value") != "") & ~F.col("value").startswith("#"))
    rows = rows.withColumn("w", F.split("value", " ")).withColumn("tag", F.col("w")[0]).where(F.col("tag").isin("v", "vt", "vn", "usemtl", "f"))
    so_far = Window.partitionBy("mesh_id").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for tag in ("v", "vt", "vn", "f"):
        rows = rows.withColumn(f"n_{tag}", F.sum(F.when(F.col("tag") == tag, 1).otherwise(0)).over(so_far))
    rows = rows.withColumn("used", F.last(F.when(F.col("tag") == "usemtl", F.substring("value", 8, 1 << 20)), ignorenulls=True).over(so_far))
    number = lambda k: F.col("w")[k].cast("double")
    table = lambda tag, key, names: rows.where(F.col("tag") == tag).select("mesh_id", (F.col(f"n_{tag}") - 1).alias(key), *[number(k + 1).alias(n) for k, n in enumerate(names)])
    first = rows.where("tag = 'usemtl'").groupBy("mesh_id", "used").agg(F.min("line").alias("line"))
    materials = first.select("mesh_id", "used", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("line")).cast("long") - 1).alias("material"))

    def index(corner: Column, part: int, count: str) -> Column:
        text = F.get(F.split(corner, "/"), F.lit(part))
        i = F.when((F.col("tag") == "f") & (text != ""), text.cast("long"))
        return F.when(i < 0, F.col(count) + i).otherwise(i - 1)

    faces = rows.where("tag = 'f'").withColumn("corners", F.slice("w", 2, 1 << 20))
    faces = faces.withColumn("corners", F.when(F.size("corners") == 3, F.col("corners")).otherwise(F.raise_error(F.concat(F.lit("face that isn't a triangle in line "), F.col("line").cast("string")))))
    arrays = [F.transform("corners", _index_of(index, part, count)).alias(name) for part, count, name in ((0, "n_v", "v"), (1, "n_vt", "t"), (2, "n_vn", "n"))]
    faces = faces.select("mesh_id", (F.col("n_f") - 1).alias("fid"), "used", *arrays)
    any_of = lambda name: F.max(F.exists(name, lambda x: x.isNotNull())).over(Window.partitionBy("mesh_id"))
    faces = faces.withColumn("t", F.when(any_of("t"), F.col("t"))).withColumn("n", F.when(any_of("n"), F.col("n")))
    faces = faces.join(materials, ["mesh_id", "used"], "left").select("mesh_id", "fid", "v", "t", "n", F.coalesce("material", F.lit(0)).cast("long").alias("material"))
    return Mesh(table("v", "vid", "xyz"), faces, table("vt", "tid", "uv"), table("vn", "nid", ["nx", "ny", "nz"]))


def _index_of(index, part: int, count: str):
    return lambda corner: index(corner, part, count)


def read_obj(spark: SparkSession, path: str) -> Mesh:
    return parse(read_lines(spark, path))
