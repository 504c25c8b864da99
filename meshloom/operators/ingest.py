"""Normalization and ingest: degenerate faces, welding, adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..schema import Mesh
from .graph import components
from .spatial import distance_join
from .tables import settle

#: Defaults, as shares of the bounding box's diagonal and of its square.
DELTA_WELD, EPSILON_AREA = 1e-4, 1e-8


def bounds(vertex: DataFrame) -> DataFrame:
    """(mesh_id, lox..hiz, diag) of all vertices; nothing for a mesh without any."""
    ends = vertex.groupBy("mesh_id").agg(*[F.min(k).alias(f"lo{k}") for k in "xyz"], *[F.max(k).alias(f"hi{k}") for k in "xyz"])
    return ends.withColumn("diag", g.length(tuple(F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz")))


def normalize(mesh: Mesh) -> Mesh:
    """Longest extent 1, centred on x and z, standing on y = 0. A mesh without extent is only moved."""
    b = bounds(mesh.vertex)
    most = F.greatest(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz"])
    b = b.withColumn("scale", F.when(most > 0, 1.0 / most).otherwise(F.lit(1.0)))
    # one row a mesh
    rows = mesh.vertex.join(b, "mesh_id")
    low = {k: F.col(f"lo{k}") * F.col("scale") for k in "xyz"}
    high = {k: F.col(f"hi{k}") * F.col("scale") for k in "xyz"}
    move = {"x": -(low["x"] + high["x"]) / 2.0, "y": -low["y"], "z": -(low["z"] + high["z"]) / 2.0}
    moved = rows.select("mesh_id", "vid", *[(F.col(k) * F.col("scale") + move[k]).alias(k) for k in "xyz"])
    return Mesh(moved, mesh.face, mesh.uv, mesh.normal)


def with_corners(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """face with p, the three corner positions (array of structs x, y, z)."""
    each = face.select("mesh_id", "fid", F.posexplode("v").alias("c", "vid"))
    p = each.join(vertex, ["mesh_id", "vid"]).groupBy("mesh_id", "fid").agg(F.array_sort(F.collect_list(F.struct("c", "x", "y", "z"))).alias("p"))
    p = p.withColumn("p", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), q["z"].alias("z"))))
    return face.join(p, ["mesh_id", "fid"])


def with_geometry(face: DataFrame, vertex: DataFrame) -> DataFrame:
    """face with p, area, centroid (cx, cy, cz) and unit normal (nx, ny, nz)."""
    rows = with_corners(face, vertex)
    c, n = g.centroid(F.col("p")), g.unit_normal(F.col("p"))
    return rows.select("*", g.triangle_area(F.col("p")).alias("area"), *[c[k].alias(f"c{a}") for k, a in enumerate("xyz")], *[n[k].alias(f"n{a}") for k, a in enumerate("xyz")])


def weld(vertex: DataFrame, tolerance: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tolerance (mesh_id, delta) -> (welded vertices, (mesh_id, old_vid, vid)).

    Vertices at distance <= delta are one, transitively; a group's position is the mean of its members and ids are dense in
    the order of each group's first member. delta 0 welds nothing."""
    rows = vertex.join(tolerance, "mesh_id")
    real = rows.where("delta > 0")
    # vertices of one position are one group whatever delta is; only one of them looks for neighbours
    spot = real.groupBy("mesh_id", "x", "y", "z", "delta").agg(F.min("vid").alias("vid"))
    same = real.join(spot.withColumnRenamed("vid", "other"), ["mesh_id", "x", "y", "z", "delta"]).select("mesh_id", F.col("vid").alias("a"), F.col("other").alias("b"))
    right = spot.select("mesh_id", F.col("vid").alias("other"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"), "delta")
    pairs = distance_join(spot, right, F.col("delta"), F.col("delta")).where("vid < other").select("mesh_id", F.col("vid").alias("a"), F.col("other").alias("b"))
    roots = components(vertex.select("mesh_id", F.col("vid").alias("node")), same.union(pairs))
    firsts = roots.select("mesh_id", "root").distinct().withColumn("vid", F.row_number().over(Window.partitionBy("mesh_id").orderBy("root")).cast("long") - 1)
    mapping = settle(roots.join(firsts, ["mesh_id", "root"]).select("mesh_id", F.col("node").alias("old_vid"), "vid"))
    welded = vertex.withColumnRenamed("vid", "old_vid").join(mapping, ["mesh_id", "old_vid"]).groupBy("mesh_id", "vid").agg(*[F.avg(k).alias(k) for k in "xyz"])
    return settle(welded), mapping


def edges_of(face: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, fid): a row for each side of each face."""
    v = F.col("v")
    sides = F.array(*[F.struct(F.least(v[i], v[j]).alias("lo"), F.greatest(v[i], v[j]).alias("hi")) for i, j in ((0, 1), (1, 2), (2, 0))])
    return face.select("mesh_id", "fid", F.explode(sides).alias("e")).select("mesh_id", "e.lo", "e.hi", "fid")


def edge_incidence(face: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, faces, n, kind): boundary with one face, manifold with two, nonmanifold with more."""
    rows = edges_of(face).groupBy("mesh_id", "lo", "hi").agg(F.array_sort(F.collect_list("fid")).alias("faces"))
    n = F.size("faces")
    return rows.select("*", n.alias("n"), F.when(n == 1, "boundary").when(n == 2, "manifold").otherwise("nonmanifold").alias("kind"))


@dataclass
class Working:
    """face: fid (dense), source_fid, v, t, n, material, p, area, cx..cz, nx..nz."""

    vertex: DataFrame
    face: DataFrame
    weld: DataFrame
    stats: DataFrame
    uv: DataFrame | None = None
    normal: DataFrame | None = None


def ingest(mesh: Mesh, delta_weld: float | None = None, epsilon_area: float | None = None) -> Working:
    """Drop degenerate faces, weld positions, drop what welding made degenerate. A NaN area counts as degenerate."""
    tolerance = bounds(mesh.vertex).select(
        "mesh_id",
        (F.col("diag") * DELTA_WELD if delta_weld is None else F.lit(float(delta_weld))).alias("delta"),
        (F.col("diag") * F.col("diag") * EPSILON_AREA if epsilon_area is None else F.lit(float(epsilon_area))).alias("epsilon"),
    )
    solid = lambda rows: rows.join(tolerance.select("mesh_id", "epsilon"), "mesh_id").where((F.col("area") >= F.col("epsilon")) & ~F.isnan("area")).drop("epsilon")
    measured = with_corners(mesh.face, mesh.vertex).withColumn("area", g.triangle_area(F.col("p")))
    purged = settle(solid(measured).drop("p"))
    vertex, mapping = weld(mesh.vertex, tolerance)
    each = purged.select("mesh_id", "fid", F.posexplode("v").alias("c", "old_vid")).join(mapping, ["mesh_id", "old_vid"])
    moved = each.groupBy("mesh_id", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "vid"))), lambda q: q["vid"]).alias("v"))
    again = purged.drop("v", "area").join(moved, ["mesh_id", "fid"])
    kept = solid(with_geometry(again, vertex))
    order = Window.partitionBy("mesh_id").orderBy("source_fid")
    face = settle(kept.withColumnRenamed("fid", "source_fid").withColumn("fid", F.row_number().over(order).cast("long") - 1))
    before = purged.groupBy("mesh_id").agg(F.sum("area").alias("area_before"))
    after = face.groupBy("mesh_id").agg(F.count("*").alias("surviving_face_count"), F.sum("area").alias("area_after"))
    faces = mesh.face.groupBy("mesh_id").agg(F.count("*").alias("original_face_count"))
    count = lambda df, name: df.groupBy("mesh_id").agg(F.count("*").alias(name))
    stats = (
        tolerance.join(faces, "mesh_id", "left").join(after, "mesh_id", "left").join(before, "mesh_id", "left")
        .join(count(mesh.vertex, "original_vertex_count"), "mesh_id").join(count(vertex, "welded_vertex_count"), "mesh_id")
        .na.fill(0)
        .select("mesh_id", "original_face_count", (F.col("original_face_count") - F.col("surviving_face_count")).alias("degenerate_face_count"), "surviving_face_count", "original_vertex_count", "welded_vertex_count", "area_before", "area_after", F.col("delta").alias("delta_weld"), F.col("epsilon").alias("epsilon_area"))
    )
    return Working(vertex, face, mapping, stats, mesh.uv, mesh.normal)
