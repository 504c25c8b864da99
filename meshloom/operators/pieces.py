"""Measures of a labelling, and the pieces it cuts a mesh into."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from .ingest import Working, bounds, edge_incidence
from .spatial import box_overlaps

ADJACENCY, GAP = 0.01, 0.001


def region_table(face: DataFrame, label: DataFrame, regions: DataFrame) -> DataFrame:
    """regions (mesh_id, region), all of them -> + faces, area, elongation; an empty region has none, 0 and 1."""
    rows = face.join(label, ["mesh_id", "fid"])
    cov = {a + b: F.covar_pop(f"c{a}", f"c{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")}
    own = rows.groupBy("mesh_id", "region").agg(F.count("*").alias("faces"), F.sum("area").alias("area"), *[c.alias(name) for name, c in cov.items()])
    _, mid, high = g.eigenvalues(*[F.col(n) for n in ("xx", "yy", "zz", "xy", "xz", "yz")])
    rho = F.when(F.col("faces") < 2, F.lit(1.0)).otherwise(high / F.greatest(mid, high * 1e-9, F.lit(1e-300)))
    return regions.join(own.withColumn("elongation", rho).select("mesh_id", "region", "faces", "area", "elongation"), ["mesh_id", "region"], "left").na.fill({"faces": 0, "area": 0.0, "elongation": 1.0})


def seam_edges(working: Working, label: DataFrame) -> DataFrame:
    """(mesh_id, lo, hi, length) of edges whose faces carry several labels."""
    each = edge_incidence(working.face).where("n > 1").select("mesh_id", "lo", "hi", F.explode("faces").alias("fid")).join(label, ["mesh_id", "fid"])
    cut = each.groupBy("mesh_id", "lo", "hi").agg(F.min("region").alias("a"), F.max("region").alias("b")).where("a <> b").select("mesh_id", "lo", "hi")
    end = lambda s: working.vertex.select("mesh_id", F.col("vid").alias(s), *[F.col(c).alias(f"{s}{c}") for c in "xyz"])
    return cut.join(end("lo"), ["mesh_id", "lo"]).join(end("hi"), ["mesh_id", "hi"]).select("mesh_id", "lo", "hi", g.length(g.sub(g.point("lo"), g.point("hi"))).alias("length"))


def scores(working: Working, label: DataFrame, regions: DataFrame, abar: DataFrame, cap: float = 20.0) -> DataFrame:
    """(mesh_id, deviation, seam, score)."""
    table = region_table(working.face, label, regions).join(abar, "mesh_id")
    agg = table.groupBy("mesh_id").agg(F.max(F.abs(F.col("area") - F.col("abar")) / F.col("abar")).alias("deviation"), F.avg(F.least("elongation", F.lit(cap))).alias("long"))
    seam = seam_edges(working, label).groupBy("mesh_id").agg(F.sum("length").alias("seam"))
    rows = agg.join(seam, "mesh_id", "left").join(bounds(working.vertex).select("mesh_id", "diag"), "mesh_id").na.fill({"seam": 0.0})
    return rows.select("mesh_id", "deviation", "seam", (F.col("deviation") + F.col("seam") / F.col("diag") + (F.col("long") - 1.0) / (cap - 1.0)).alias("score"))


@dataclass
class Pieces:
    """face: piece, region, pfid (its place in the piece), v, t, n (places in the piece's own tables); piece numbers skip empty
    regions."""

    face: DataFrame
    vertex: DataFrame
    uv: DataFrame | None
    normal: DataFrame | None


def _compacted(face: DataFrame, column: str, key: str, table: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(face key -> places in the piece, the piece's own table): places follow the ids used. Null ids stay null."""
    each = face.select("mesh_id", "piece", "fid", F.posexplode(column).alias("c", key))
    used = each.where(F.col(key).isNotNull()).select("mesh_id", "piece", key).distinct().withColumn("place", F.row_number().over(Window.partitionBy("mesh_id", "piece").orderBy(key)).cast("long") - 1)
    places = each.join(used, ["mesh_id", "piece", key], "left").groupBy("mesh_id", "fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "place"))), lambda q: q["place"]).alias(column))
    return places, used.join(table, ["mesh_id", key]).select("mesh_id", "piece", F.col("place").alias(key), F.col(key).alias(f"source_{key}"), *values)


def extract(working: Working, label: DataFrame) -> Pieces:
    rows = working.face.join(label, ["mesh_id", "fid"])
    order = rows.select("mesh_id", "region").distinct().withColumn("piece", F.row_number().over(Window.partitionBy("mesh_id").orderBy("region")).cast("long") - 1)
    rows = rows.join(order, ["mesh_id", "region"])
    v, vertex = _compacted(rows, "v", "vid", working.vertex, ["x", "y", "z"])
    out, uv, normal = rows.drop("v").join(v, ["mesh_id", "fid"]), None, None
    if working.uv is not None:
        t, uv = _compacted(rows, "t", "tid", working.uv, ["u", "v"])
        out = out.drop("t").join(t, ["mesh_id", "fid"], "left")
    if working.normal is not None:
        n, normal = _compacted(rows, "n", "nid", working.normal, ["nx", "ny", "nz"])
        out = out.drop("n").join(n, ["mesh_id", "fid"], "left")
    place = F.row_number().over(Window.partitionBy("mesh_id", "piece").orderBy("fid")).cast("long") - 1
    return Pieces(out.withColumn("pfid", place), vertex, uv, normal)


def piece_table(pieces: Pieces) -> DataFrame:
    """(mesh_id, piece, faces, vertices, area, bounds, box centre bx.., area centre ax..): without area the mean of the vertices."""
    box = pieces.vertex.groupBy("mesh_id", "piece").agg(F.count("*").alias("vertices"), *[F.min(k).alias(f"lo{k}") for k in "xyz"], *[F.max(k).alias(f"hi{k}") for k in "xyz"], *[F.avg(k).alias(f"m{k}") for k in "xyz"])
    own = pieces.face.groupBy("mesh_id", "piece").agg(F.count("*").alias("faces"), F.sum("area").alias("area"), *[F.sum(F.col("area") * F.col(f"c{k}")).alias(f"s{k}") for k in "xyz"])
    rows = box.join(own, ["mesh_id", "piece"])
    mass = [F.when(F.col("area") <= 0, F.col(f"m{k}")).otherwise(F.col(f"s{k}") / F.col("area")).alias(f"a{k}") for k in "xyz"]
    middle = [((F.col(f"lo{k}") + F.col(f"hi{k}")) / 2.0).alias(f"b{k}") for k in "xyz"]
    return rows.select("mesh_id", "piece", "faces", "vertices", "area", *[f"{e}{k}" for e in ("lo", "hi") for k in "xyz"], *middle, *mass)


def piece_adjacency(table: DataFrame, threshold: float = ADJACENCY) -> DataFrame:
    """(mesh_id, piece_a, piece_b, ox, oy, oz): neighbouring boxes, both ways, and the offset of a's box centre from b's."""
    met = box_overlaps(table, threshold).select("mesh_id", "piece_a", "piece_b", *[f"b{k}" for k in "xyz"])
    other = table.select("mesh_id", F.col("piece").alias("piece_b"), *[F.col(f"b{k}").alias(f"q{k}") for k in "xyz"])
    return met.join(other, ["mesh_id", "piece_b"]).select("mesh_id", "piece_a", "piece_b", *[(F.col(f"b{k}") - F.col(f"q{k}")).alias(f"o{k}") for k in "xyz"])


def checkpoint_json(vertex: DataFrame, pieces: Pieces, gap: float = GAP, seed: int | None = None, source: str = "normalized.glb") -> DataFrame:
    """(mesh_id, json): the manifest of each mesh, keys in their fixed order, nulls written."""
    table = piece_table(pieces)
    xyz = lambda s: F.array(*[F.col(f"{s}{k}") for k in "xyz"])
    ordered = lambda field: F.transform(F.array_sort("all"), lambda q: q[field])
    own = table.groupBy("mesh_id").agg(F.collect_list(F.struct("piece", xyz("b").alias("box"), xyz("a").alias("mass"), "vertices")).alias("all"))
    near = piece_adjacency(table).groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("piece_a", "piece_b", xyz("o").alias("offset")))).alias("adjacency"))
    b = bounds(vertex)
    rows = own.join(near, "mesh_id", "left").join(b, "mesh_id")
    payload = F.struct(
        F.size("all").alias("piece_count"), F.lit(gap).alias("gap"), F.lit(seed).cast("long").alias("seed"),
        F.struct(F.array(*[(F.col(f"lo{k}") + F.col(f"hi{k}")) / 2.0 for k in "xyz"]).alias("center"), F.array(*[F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz"]).alias("extents")).alias("total_bounds"),
        ordered("box").alias("piece_centroids"), F.coalesce("adjacency", F.array().cast("array<struct<piece_a: bigint, piece_b: bigint, offset: array<double>>>")).alias("adjacency"), F.lit(source).alias("source"),
        ordered("vertices").alias("piece_vertex_counts"), ordered("mass").alias("piece_rotation_centers"),
        F.lit(None).cast("long").alias("lowpoly_vertices"), F.lit(None).cast("long").alias("lowpoly_faces"),
        F.lit(False).alias("smooth_edges"), F.lit(1).alias("smooth_iterations"), F.lit(0.5).alias("smooth_lambda"), F.lit(0.5).alias("smooth_nu"),
    )
    return rows.select("mesh_id", F.to_json(payload, {"ignoreNullFields": "false"}).alias("json"))


def atlas(pieces: DataFrame, cell: int = 34) -> DataFrame:
    """cell: pixels of a colour with its padding. pieces (mesh_id, piece) -> + cell column and row, atlas size in pixels (a power of two), u, v and colour of the piece's cell."""
    n = F.count("*").over(Window.partitionBy("mesh_id"))
    rows = pieces.withColumn("n", n).withColumn("columns", F.ceil(F.sqrt("n"))).withColumn("rows", F.ceil(F.col("n") / F.col("columns")))
    rows = rows.withColumn("size", F.pow(F.lit(2), F.ceil(F.log2(F.greatest("columns", "rows") * cell))).cast("long"))
    rows = rows.withColumn("col", F.col("piece") % F.col("columns")).withColumn("row", F.floor(F.col("piece") / F.col("columns")))
    r, gr, b = g.hsv(F.col("piece") / F.col("n"), 0.8, 0.9)
    return rows.withColumn("u", (F.col("col") + 0.5) * cell / F.col("size")).withColumn("v", 1.0 - (F.col("row") + 0.5) * cell / F.col("size")).select("*", r.alias("r"), gr.alias("g"), b.alias("b"))


def merge_faces(pieces: Pieces) -> tuple[DataFrame, DataFrame]:
    """All pieces of a mesh as one: faces with running vertex offsets, and the vertices in that order."""
    count = pieces.vertex.groupBy("mesh_id", "piece").agg(F.count("*").alias("n"))
    before = count.withColumn("offset", F.coalesce(F.sum("n").over(Window.partitionBy("mesh_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    face = pieces.face.join(before, ["mesh_id", "piece"]).select("mesh_id", "piece", "pfid", F.transform("v", lambda x: x + F.col("offset")).alias("v"))
    return face, pieces.vertex.join(before, ["mesh_id", "piece"]).select("mesh_id", (F.col("vid") + F.col("offset")).alias("vid"), "piece", "x", "y", "z")
