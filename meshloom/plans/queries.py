"""The queries of the mesh operators over meshes derived from the tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import bridges as B
from ..operators import dual as U
from ..operators import ingest as I
from ..operators import partition as P
from ..operators import pieces as C
from ..operators import spatial as S
from ..operators import triage as T
from ..operators.tables import settle
from ..schema import Mesh
from ..sources import obj, sinks
from . import driver_mesh as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WHOLE, SEGMENTS = D.mesh_vertices(), D.segment_vertices()
N_PIECES = 7
#: Synthetic regions of a segment's mesh: bands of 100 faces.
REGION = "CAST(floor(fid / 100) AS BIGINT)"
COMP = "CAST(patch AS BIGINT)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def r6(x: Column | str, name: str | None = None) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return (F.round(c, 6) + 0.0).alias(name or x)


def s6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 AS {name}"


def _whole(spark, sf_dir) -> Mesh:
    return D.load(spark, sf_dir, WHOLE)


def _segments(spark, sf_dir) -> Mesh:
    return D.load(spark, sf_dir, SEGMENTS)


def _working(mesh: Mesh) -> I.Working:
    """A mesh whose vertices are distinct, without welding."""
    vertex = settle(mesh.vertex)
    return I.Working(vertex, settle(I.with_geometry(mesh.face, vertex)), None, None)


def _label(face: DataFrame) -> DataFrame:
    return face.select("mesh_id", "fid", F.expr(REGION).alias("region"))


def _abar(face: DataFrame, n: int) -> DataFrame:
    return face.groupBy("mesh_id").agg((F.sum("area") / n).alias("abar"))


@query(D.with_mesh(WHOLE) + f""" SELECT mesh_id, {COMP} AS comp, count(*) AS faces, {s6('sum(area)', 'area')}, {s6('sum(cx * area) / sum(area)', 'cx')}, {s6('sum(cy * area) / sum(area)', 'cy')}, {s6('sum(cz * area) / sum(area)', 'cz')}, max(b.boundary) AS boundary_edges
    FROM geom JOIN (SELECT patch AS p, count(*) AS boundary FROM (SELECT patch, lo, hi FROM side GROUP BY patch, lo, hi HAVING count(*) = 1) e GROUP BY patch) b ON b.p = patch GROUP BY mesh_id, patch""")
def component_summary(spark, sf_dir):
    """Flagship: components of faces with their faces, area, centroid and boundary edges."""
    w = _working(_whole(spark, sf_dir))
    comp = T.face_components(w.face)
    edge = I.edge_incidence(w.face).where("n = 1").select("mesh_id", F.col("faces")[0].alias("fid")).join(comp, ["mesh_id", "fid"]).groupBy("mesh_id", "comp").agg(F.count("*").alias("boundary_edges"))
    rows = T.component_table(w.face, comp).join(edge, ["mesh_id", "comp"], "left")
    return rows.select("mesh_id", "comp", "faces", r6("area"), r6("cx"), r6("cy"), r6("cz"), F.coalesce("boundary_edges", F.lit(0)).alias("boundary_edges"))


_FAR = lambda k: f"sqrt((x{k} - cx) * (x{k} - cx) + (y{k} - cy) * (y{k} - cy) + (z{k} - cz) * (z{k} - cz))"


@query(D.with_mesh(WHOLE) + f" SELECT mesh_id, fid, {s6('area', 'area')}, {s6('cx', 'cx')}, {s6('cy', 'cy')}, {s6('cz', 'cz')}, {s6('nx', 'nx')}, {s6('ny', 'ny')}, {s6('nz', 'nz')}, {s6('greatest(' + ', '.join(map(_FAR, range(3))) + ')', 'extent')} FROM geom")
def face_geometry(spark, sf_dir):
    w = _working(_whole(spark, sf_dir))
    return w.face.withColumn("extent", g.face_extent(F.col("p"))).select("mesh_id", "fid", *[r6(c) for c in ("area", "cx", "cy", "cz", "nx", "ny", "nz", "extent")])


_MOVED = ", ".join([s6("(max(x) - min(x)) / max(m)", "ex"), s6("(max(y) - min(y)) / max(m)", "ey"), s6("(max(z) - min(z)) / max(m)", "ez"), s6("-(max(x) - min(x)) / max(m) / 2", "lox"), s6("CAST(0 AS DOUBLE)", "loy"), s6("-(max(z) - min(z)) / max(m) / 2", "loz")])


@query(f"WITH vert AS ({SEGMENTS}) SELECT mesh_id, count(*) AS vertices, {_MOVED} FROM (SELECT *, greatest(max(x) OVER w1 - min(x) OVER w1, max(y) OVER w1 - min(y) OVER w1, max(z) OVER w1 - min(z) OVER w1) AS m FROM vert WINDOW w1 AS (PARTITION BY mesh_id)) q GROUP BY mesh_id")
def normalized_bounds(spark, sf_dir):
    moved = I.normalize(_segments(spark, sf_dir))
    b = I.bounds(moved.vertex).join(moved.vertex.groupBy("mesh_id").agg(F.count("*").alias("vertices")), "mesh_id")
    return b.select("mesh_id", "vertices", *[r6(F.col(f"hi{k}") - F.col(f"lo{k}"), f"e{k}") for k in "xyz"], *[r6(f"lo{k}") for k in "xyz"])


@query(D.with_mesh(SEGMENTS) + " SELECT mesh_id, CASE WHEN n = 1 THEN 'boundary' WHEN n = 2 THEN 'manifold' ELSE 'nonmanifold' END AS kind, count(*) AS edges FROM (SELECT mesh_id, lo, hi, count(*) AS n FROM side GROUP BY mesh_id, lo, hi) e GROUP BY 1, 2")
def edge_classes(spark, sf_dir):
    return I.edge_incidence(_segments(spark, sf_dir).face).groupBy("mesh_id", "kind").agg(F.count("*").alias("edges"))


@query(D.with_mesh(SEGMENTS) + f" SELECT v.mesh_id, count(*) AS vertices, {s6('sum(x)', 'sx')}, {s6('sum(z)', 'sz')}, max(e.n) AS boundary_edges FROM vert v JOIN (SELECT mesh_id, count(*) AS n FROM (SELECT mesh_id, lo, hi FROM side GROUP BY mesh_id, lo, hi HAVING count(*) = 1) b GROUP BY mesh_id) e ON e.mesh_id = v.mesh_id GROUP BY v.mesh_id")
def weld_soup(spark, sf_dir):
    """Faces with corners of their own, welded together again."""
    mesh = _segments(spark, sf_dir)
    own = mesh.face.select("mesh_id", "fid", F.posexplode("v").alias("c", "vid")).join(mesh.vertex, ["mesh_id", "vid"]).select("mesh_id", "fid", (F.col("fid") * 3 + F.col("c")).alias("vid"), "x", "y", "z")
    face = mesh.face.withColumn("v", F.array(*[F.col("fid") * 3 + k for k in range(3)]))
    w = I.ingest(Mesh(own.drop("fid"), face))
    edges = I.edge_incidence(w.face).where("n = 1").groupBy("mesh_id").agg(F.count("*").alias("boundary_edges"))
    return w.vertex.groupBy("mesh_id").agg(F.count("*").alias("vertices"), r6(F.sum("x"), "sx"), r6(F.sum("z"), "sz")).join(edges, "mesh_id")


_SPREAD = 0.008


@query(D.with_mesh(SEGMENTS) + f" SELECT v.mesh_id, count(*) AS vertices, {s6('sum(x)', 'sx')}, {s6('sum(z)', 'sz')}, max(e.n) AS boundary_edges FROM vert v JOIN (SELECT mesh_id, count(*) AS n FROM (SELECT mesh_id, lo, hi FROM side GROUP BY mesh_id, lo, hi HAVING count(*) = 1) b GROUP BY mesh_id) e ON e.mesh_id = v.mesh_id GROUP BY v.mesh_id")
def weld_spread(spark, sf_dir):
    """Every vertex three times along a line, the outer ones farther apart than the tolerance, which reaches the middle one."""
    mesh = _segments(spark, sf_dir)
    copies = mesh.vertex.withColumn("c", F.explode(F.array(*map(F.lit, range(3))))).select("mesh_id", (F.col("vid") * 3 + F.col("c")).alias("vid"), (F.col("x") + (F.col("c") - 1) * _SPREAD).alias("x"), "y", "z")
    face = mesh.face.withColumn("v", F.transform("v", lambda v, k: v * 3 + F.pmod(F.col("fid") + k, F.lit(3))))
    w = I.ingest(Mesh(copies, face), 1.25 * _SPREAD, 1e-9)
    edges = I.edge_incidence(w.face).where("n = 1").groupBy("mesh_id").agg(F.count("*").alias("boundary_edges"))
    return w.vertex.groupBy("mesh_id").agg(F.count("*").alias("vertices"), r6(F.sum("x"), "sx"), r6(F.sum("z"), "sz")).join(edges, "mesh_id")


@query(D.with_mesh(SEGMENTS) + f" SELECT f.mesh_id, f.n + s.n AS original_face_count, s.n AS degenerate_face_count, f.n AS surviving_face_count, {s6('f.area', 'area_after')} FROM (SELECT mesh_id, count(*) AS n, sum(area) AS area FROM geom GROUP BY mesh_id) f JOIN (SELECT mesh_id, count(*) AS n FROM vert WHERE k + 1 < n GROUP BY mesh_id) s ON s.mesh_id = f.mesh_id")
def purge_after_weld(spark, sf_dir):
    """A sliver from each vertex to its copy nearby and the next vertex has an area until the copies are welded."""
    mesh = _segments(spark, sf_dir)
    copies = mesh.vertex.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select("mesh_id", (F.col("vid") * 2 + F.col("c")).alias("vid"), "x", (F.col("y") + F.col("c") * _SPREAD).alias("y"), "z")
    last = mesh.vertex.groupBy("mesh_id").agg(F.max("vid").alias("last"))
    # the next vertex is never straight along the copies: those differ in y, it in x or z too, and a sliver along y is turned to the row before
    sliver = mesh.vertex.join(last, "mesh_id").where("vid < last").select("mesh_id", (-1 - F.col("vid")).alias("fid"), F.array(F.col("vid") * 2, F.col("vid") * 2 + 1, F.col("vid") * 2 + 2).alias("v"))
    own = mesh.face.select("mesh_id", "fid", F.transform("v", lambda v: v * 2).alias("v"))
    null = F.lit(None).cast("array<long>")
    face = own.union(sliver).select("*", null.alias("t"), null.alias("n"), F.lit(0).cast("long").alias("material"))
    return I.ingest(Mesh(copies, face), 1.25 * _SPREAD, 1e-12).stats.select("mesh_id", "original_face_count", "degenerate_face_count", "surviving_face_count", r6("area_after"))


@query(D.with_mesh(SEGMENTS) + f" SELECT mesh_id, fid, {s6('-nx', 'nx')}, {s6('-ny', 'ny')}, {s6('-nz', 'nz')} FROM geom")
def reversed_faces(spark, sf_dir):
    """Normals of faces with their winding reversed."""
    mesh = _segments(spark, sf_dir)
    turned = I.with_geometry(mesh.face.withColumn("v", g.reverse_winding(F.col("v"))), mesh.vertex)
    return turned.select("mesh_id", "fid", *[r6(f"n{k}") for k in "xyz"])


@query(D.with_mesh(SEGMENTS) + f" SELECT mesh_id, count(*) AS original_face_count, CAST(sum(CASE WHEN area < 0.55 THEN 1 ELSE 0 END) AS BIGINT) AS degenerate_face_count, CAST(sum(CASE WHEN area >= 0.55 THEN 1 ELSE 0 END) AS BIGINT) AS surviving_face_count, {s6('sum(CASE WHEN area >= 0.55 THEN area ELSE 0 END)', 'area_after')} FROM geom GROUP BY mesh_id")
def ingest_stats(spark, sf_dir):
    stats = I.ingest(_segments(spark, sf_dir), 0.0, 0.55).stats
    return stats.select("mesh_id", "original_face_count", "degenerate_face_count", "surviving_face_count", r6("area_after"))


_COMPS = f"comps AS (SELECT mesh_id, {COMP} AS comp, sum(area) AS area, sum(cx * area) / sum(area) AS cx, sum(cy * area) / sum(area) AS cy, sum(cz * area) / sum(area) AS cz FROM geom GROUP BY mesh_id, patch), marked AS (SELECT *, sum(area) OVER () / {N_PIECES} AS abar, area >= 0.25 * sum(area) OVER () / {N_PIECES} AS is_major FROM comps)"
_HOSTS = "hosts AS (SELECT s.comp, arg_min(m.comp, (s.cx - m.cx) * (s.cx - m.cx) + (s.cy - m.cy) * (s.cy - m.cy) + (s.cz - m.cz) * (s.cz - m.cz)) AS host FROM marked s JOIN marked m ON m.is_major AND NOT s.is_major GROUP BY s.comp)"


@query(D.with_mesh(WHOLE) + f""", {_COMPS}, {_HOSTS},
    weights AS (SELECT m.comp, m.area + coalesce((SELECT sum(s.area) FROM marked s JOIN hosts h ON h.comp = s.comp WHERE h.host = m.comp), 0) AS weight FROM marked m WHERE m.is_major),
    quotas AS (SELECT comp, weight / sum(weight) OVER () * ({N_PIECES} - count(*) OVER ()) AS q, {N_PIECES} - count(*) OVER () AS rest FROM weights),
    ranked AS (SELECT comp, floor(q) AS whole, rest - sum(floor(q)) OVER () AS more, row_number() OVER (ORDER BY q - floor(q) DESC, comp) AS k FROM quotas)
    SELECT mesh_id, m.comp, is_major, host, CAST(1 + whole + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS pieces FROM marked m LEFT JOIN hosts h ON h.comp = m.comp LEFT JOIN ranked r ON r.comp = m.comp""")
def triage_pieces(spark, sf_dir):
    _, rows = T.triage(_working(_whole(spark, sf_dir)).face, N_PIECES)
    return rows.select("mesh_id", "comp", "is_major", "host", "pieces")


_SOLID = """SELECT s.mesh_id, s.comp AS sat, CAST(g.patch AS BIGINT) AS major, x0 - s.cx AS ax, y0 - s.cy AS ay, z0 - s.cz AS az, x1 - s.cx AS bx, y1 - s.cy AS by_, z1 - s.cz AS bz, x2 - s.cx AS dx, y2 - s.cy AS dy, z2 - s.cz AS dz FROM marked s JOIN geom g ON g.patch <> s.comp WHERE NOT s.is_major"""


@query(D.with_mesh(WHOLE) + f""", {_COMPS}, seen AS ({_SOLID}),
    sized AS (SELECT *, sqrt(ax * ax + ay * ay + az * az) AS la, sqrt(bx * bx + by_ * by_ + bz * bz) AS lb, sqrt(dx * dx + dy * dy + dz * dz) AS ld FROM seen)
    SELECT mesh_id, sat, major, {s6('sum(2 * atan2(ax * (by_ * dz - bz * dy) + ay * (bz * dx - bx * dz) + az * (bx * dy - by_ * dx), la * lb * ld + (ax * bx + ay * by_ + az * bz) * ld + (bx * dx + by_ * dy + bz * dz) * la + (dx * ax + dy * ay + dz * az) * lb)) / (4 * 3.141592653589793)', 'wn')} FROM sized GROUP BY mesh_id, sat, major""")
def winding_numbers(spark, sf_dir):
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    major = w.face.join(comp, ["mesh_id", "fid"]).join(rows.where("is_major").select("mesh_id", "comp"), ["mesh_id", "comp"], "left_semi").select("mesh_id", F.col("comp").alias("other"), F.col("p").alias("op"))
    return B.winding_numbers(rows, major).select("mesh_id", "sat", "major", r6("wn"))


def _hits_sql(final: str) -> str:
    dots = lambda a, b: " + ".join(f"{a}{k} * {b}{k}" for k in "xyz")
    pairs = "pairs AS (SELECT s.mesh_id, CAST(s.patch AS BIGINT) AS sat, s.fid AS sat_face, CAST(m.patch AS BIGINT) AS other, m.fid AS other_face, s.nx * m.nx + s.ny * m.ny + s.nz * m.nz AS agreement, " + ", ".join(f"m.{k}1 - m.{k}0 AS ab{k}, m.{k}2 - m.{k}0 AS ac{k}, s.c{k} - m.{k}0 AS aq{k}, s.c{k} - m.{k}1 AS bq{k}, s.c{k} - m.{k}2 AS cq{k}" for k in "xyz") + " FROM geom s JOIN marked t ON t.comp = s.patch AND NOT t.is_major JOIN geom m ON m.patch <> s.patch)"
    d = "dots AS (SELECT *, " + ", ".join(f"{dots(a, b)} AS d{n}" for n, (a, b) in enumerate((("ab", "aq"), ("ac", "aq"), ("ab", "bq"), ("ac", "bq"), ("ab", "cq"), ("ac", "cq")), 1)) + " FROM pairs)"
    v3 = "vees AS (SELECT *, d3 * d6 - d5 * d4 AS va, d5 * d2 - d1 * d6 AS vb, d1 * d4 - d3 * d2 AS vc FROM dots)"
    case = lambda a, b, c, e, f, h, i: f"CASE WHEN d1 <= 0 AND d2 <= 0 THEN {a} WHEN d3 >= 0 AND d4 <= d3 THEN {b} WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN {c} WHEN d6 >= 0 AND d5 <= d6 THEN {e} WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN {f} WHEN va <= 0 AND d4 - d3 >= 0 AND d5 - d6 >= 0 THEN {h} ELSE {i} END"
    st = "placed AS (SELECT *, " + case("0", "1", "d1 / (d1 - d3)", "0", "0", "1 - (d4 - d3) / ((d4 - d3) + (d5 - d6))", "vb / (va + vb + vc)") + " AS s, " + case("0", "0", "0", "1", "d2 / (d2 - d6)", "(d4 - d3) / ((d4 - d3) + (d5 - d6))", "vc / (va + vb + vc)") + " AS t FROM vees)"
    far = "far AS (SELECT mesh_id, sat, sat_face, other, other_face, agreement, sqrt(" + " + ".join(f"(aq{k} - s * ab{k} - t * ac{k}) * (aq{k} - s * ab{k} - t * ac{k})" for k in "xyz") + ") AS dist FROM placed)"
    best = "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, sat, other_face ORDER BY dist, sat_face) AS k FROM far) q WHERE k = 1)"
    first = "first AS (SELECT best.*, row_number() OVER (PARTITION BY best.mesh_id, sat ORDER BY dist, other_face) AS r FROM best JOIN hosts ON hosts.comp = sat AND hosts.host = other)"
    top = "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, sat ORDER BY dist, other_face) AS r FROM best) q WHERE r <= 5)"
    tau = "tau AS (SELECT patch, least(1.25 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)), max(cap)) AS tau FROM vert JOIN (SELECT 0.03 * sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS cap FROM vert) c ON true GROUP BY patch)"
    return D.with_mesh(WHOLE) + f", {_COMPS}, {_HOSTS}, {pairs}, {d}, {v3}, {st}, {far}, {best}, {first}, {top}, {tau}, found AS (SELECT * FROM top JOIN tau ON patch = sat WHERE dist <= tau AND agreement >= 0) {final}"


@query(_hits_sql(f"SELECT mesh_id, sat, sat_face, other, other_face, {s6('dist', 'dist')}, {s6('agreement', 'agreement')} FROM found"))
def bridges(spark, sf_dir):
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    return B.build_bridges(w, comp, rows).bridge.where("not via_enclosure").select("mesh_id", "sat", "sat_face", "other", "other_face", r6("dist"), r6("agreement"))


@query(_hits_sql(f"SELECT mesh_id, sat, arg_min(sat_face, dist) AS sat_face, arg_min(other, dist) AS other, arg_min(other_face, dist) AS other_face, {s6('min(dist)', 'dist')} FROM found GROUP BY mesh_id, sat"))
def anchors(spark, sf_dir):
    """The nearest bridge of each satellite."""
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    return B.build_bridges(w, comp, rows).anchor.where("not via_enclosure and not forced").select("mesh_id", "sat", "sat_face", "other", "other_face", r6("dist"))


@query(_hits_sql(f"SELECT mesh_id, sat_face AS a, other_face AS b, {s6('greatest(dist * 5, CAST(1e-12 AS DOUBLE))', 'cost')} FROM found"))
def bridge_edges(spark, sf_dir):
    """Edges of the weighted graph that bridges give."""
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    return U.dual_graph(w, B.build_bridges(w, comp, rows).bridge).where("is_bridge").select("mesh_id", "a", "b", r6("cost"))


@query(_hits_sql(f"SELECT mesh_id, sat, sat_face, other, other_face, {s6('dist', 'dist')}, {s6('agreement', 'agreement')}, true AS forced FROM first WHERE r = 1"))
def forced_bridges(spark, sf_dir):
    """With no gap allowed, every satellite that isn't enclosed is tied to the nearest face of its host."""
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    return B.build_bridges(w, comp, rows, tau_max=0.0, force_exact_count=True).anchor.where("not via_enclosure").select("mesh_id", "sat", "sat_face", "other", "other_face", r6("dist"), r6("agreement"), "forced")


@query(D.with_mesh(WHOLE) + f""", {_COMPS}, quotas AS (SELECT mesh_id, comp, area / sum(area) OVER () * ({N_PIECES} - count(*) OVER ()) AS q, {N_PIECES} - count(*) OVER () AS rest FROM comps),
    ranked AS (SELECT mesh_id, comp, floor(q) AS whole, rest - sum(floor(q)) OVER () AS more, row_number() OVER (ORDER BY q - floor(q) DESC, comp) AS k FROM quotas)
    SELECT r.mesh_id, r.comp, NOT m.is_major AS promoted, CAST(1 + whole + CASE WHEN k <= more THEN 1 ELSE 0 END AS BIGINT) AS pieces FROM ranked r JOIN marked m ON m.comp = r.comp""")
def promoted_pieces(spark, sf_dir):
    """With no gap allowed and nothing forced, satellites become majors and the pieces are dealt out again."""
    w = _working(_whole(spark, sf_dir))
    comp, rows = T.triage(w.face, N_PIECES)
    found = B.build_bridges(w, comp, rows, tau_max=0.0)
    marked = T.pieces_of(found.components, N_PIECES).join(found.promoted.withColumn("promoted", F.lit(True)), ["mesh_id", "comp"], "left")
    return marked.select("mesh_id", "comp", F.coalesce("promoted", F.lit(False)).alias("promoted"), "pieces")


@query("""SELECT s_suppkey AS mesh_id, CAST(1 AS BIGINT) AS sat, CAST(0 AS BIGINT) AS other, true AS via_enclosure, CAST(1 AS DOUBLE) AS wn, round(CAST(0.7 AS DOUBLE) - CAST(0.05 AS DOUBLE) * (s_suppkey % 7), 6) + 0.0 AS dist FROM supplier""")
def enclosed_satellites(spark, sf_dir):
    """A cube for each supplier with a small one inside, nearer to its face x = 1: it is tied to the cube, whatever the gap."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("mesh_id"), (0.3 + 0.05 * F.pmod("s_suppkey", F.lit(7))).alias("at"))
    corners = [(a, b, c) for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0)]
    quads = ((0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3))
    sides = [t for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]
    point = lambda k, size, x: F.struct(F.lit(k).cast("long").alias("vid"), *[(F.lit(size * q) + (x if axis == "x" else 0.0)).alias(axis) for axis, q in zip("xyz", corners[k % 8], strict=True)])
    points = [point(k, 1.0, F.lit(0.0)) for k in range(8)] + [point(k, 0.01, F.col("at")) for k in range(8, 16)]
    faces = [F.struct(F.lit(12 * s + k).cast("long").alias("fid"), F.array(*[F.lit(8 * s + v).cast("long") for v in t]).alias("v")) for s in (0, 1) for k, t in enumerate(sides)]
    null = F.lit(None).cast("array<long>")
    face = rows.select("mesh_id", F.explode(F.array(*faces)).alias("f")).select("mesh_id", "f.*", null.alias("t"), null.alias("n"), F.lit(0).cast("long").alias("material"))
    w = _working(Mesh(rows.select("mesh_id", F.explode(F.array(*points)).alias("p")).select("mesh_id", "p.*"), face))
    comp, table = T.triage(w.face, 3)
    found = B.build_bridges(w, comp, table)
    anchor = found.anchor.join(found.winding.withColumnRenamed("major", "other"), ["mesh_id", "sat", "other"])
    # the anchor's face of the small cube is the one toward x = 1, its centroid 0.01 nearer
    return anchor.select("mesh_id", "sat", "other", "via_enclosure", r6("wn"), r6(F.col("dist") + 0.01, "dist"))


_DUAL = """dual AS (SELECT p.mesh_id, p.fid AS a, q.fid AS b, p.lo, p.hi FROM side p JOIN side q ON q.mesh_id = p.mesh_id AND q.lo = p.lo AND q.hi = p.hi AND p.fid < q.fid),
    off AS (SELECT d.*, a.cx AS acx, a.cy AS acy, a.cz AS acz, a.nx AS anx, a.ny AS any_, a.nz AS anz, b.cx AS bcx, b.cy AS bcy, b.cz AS bcz, b.nx AS bnx, b.ny AS bny, b.nz AS bnz, l.x AS px, l.y AS py, l.z AS pz, o.x AS ox, o.y AS oy, o.z AS oz
      FROM dual d JOIN geom a ON a.mesh_id = d.mesh_id AND a.fid = d.a JOIN geom b ON b.mesh_id = d.mesh_id AND b.fid = d.b JOIN vert l ON l.mesh_id = d.mesh_id AND l.vid = d.lo JOIN vert o ON o.mesh_id = d.mesh_id AND o.vid = b.a + b.b + b.c - d.lo - d.hi),
    costs AS (SELECT mesh_id, a, b, CASE WHEN anx * (ox - px) + any_ * (oy - py) + anz * (oz - pz) <= 0 THEN CAST(0 AS DOUBLE) ELSE greatest(1 - (anx * bnx + any_ * bny + anz * bnz), CAST(0 AS DOUBLE)) END AS concavity, sqrt((acx - bcx) * (acx - bcx) + (acy - bcy) * (acy - bcy) + (acz - bcz) * (acz - bcz)) AS far FROM off),
    cost AS (SELECT mesh_id, a, b, concavity, greatest(far * (1 + 2 * concavity), CAST(1e-12 AS DOUBLE)) AS cost FROM costs)"""


@query(D.with_mesh(SEGMENTS) + f", {_DUAL} SELECT mesh_id, a, b, {s6('cost', 'cost')}, {s6('concavity', 'concavity')} FROM cost")
def dual_edges(spark, sf_dir):
    return U.surface_edges(_working(_segments(spark, sf_dir))).select("mesh_id", "a", "b", r6("cost"), r6("concavity"))


def _graph(spark, sf_dir):
    w = _working(_segments(spark, sf_dir))
    return w, w.face.select("mesh_id", "fid", F.lit(0).cast("long").alias("comp")), U.settle(U.surface_edges(w))


@query(D.with_mesh(SEGMENTS).replace("WITH ", "WITH RECURSIVE ", 1) + f", {_DUAL}, both_ AS MATERIALIZED (SELECT mesh_id, a, b, cost FROM cost UNION ALL SELECT mesh_id, b, a, cost FROM cost), " + f"""reach(mesh_id, fid, dist) USING KEY (mesh_id, fid) AS (
      SELECT DISTINCT mesh_id, CAST(0 AS BIGINT), CAST(0 AS DOUBLE) FROM cost
      UNION SELECT n.mesh_id, n.fid, n.dist FROM (SELECT r.mesh_id, e.b AS fid, min(r.dist + e.cost) AS dist FROM reach r JOIN both_ e ON e.mesh_id = r.mesh_id AND e.a = r.fid GROUP BY r.mesh_id, e.b) n
        LEFT JOIN recurring.reach o ON o.mesh_id = n.mesh_id AND o.fid = n.fid WHERE n.dist < coalesce(o.dist, CAST('Infinity' AS DOUBLE)))
    SELECT mesh_id, fid, {s6('dist', 'dist')} FROM reach""")
def seed_distances(spark, sf_dir):
    """Shortest paths over faces from each mesh's first face."""
    w, comp, dual = _graph(spark, sf_dir)
    return P.distances(w, comp, dual, w.face.groupBy("mesh_id").agg(F.min("fid").alias("fid"))).select("mesh_id", "fid", r6("dist"))


@query()
def farthest_seeds(spark, sf_dir):
    w, comp, dual = _graph(spark, sf_dir)
    return P.seed(w, comp, dual, w.face.groupBy("mesh_id").agg(F.lit(0).cast("long").alias("comp"), F.lit(6).alias("pieces")))


def _grown(spark, sf_dir):
    w, comp, dual = _graph(spark, sf_dir)
    seeds = P.seed(w, comp, dual, w.face.groupBy("mesh_id").agg(F.lit(0).cast("long").alias("comp"), F.lit(6).alias("pieces")))
    none = seeds.limit(0).select("mesh_id", F.col("major").alias("sat"), F.col("fid").alias("other_face"))
    return w, comp, dual, seeds, none, _abar(w.face, 6)


@query()
def capacity_growth(spark, sf_dir):
    labels, claims = P.grow(*_grown(spark, sf_dir))
    return labels.join(claims.select("mesh_id", "fid", "seq", r6("key")), ["mesh_id", "fid"], "left")


@query()
def relaxed_labels(spark, sf_dir):
    return P.relax(*_grown(spark, sf_dir))["label"]


@query()
def relaxed_iterations(spark, sf_dir):
    return P.relax(*_grown(spark, sf_dir))["iteration"].select("mesh_id", "it", r6("deviation"), r6("seam"), r6("score"), "best", "converged")


_LAB = D.with_mesh(SEGMENTS) + f", lab AS (SELECT *, {REGION} AS region FROM geom)"
_ISLANDS = """island AS (SELECT * FROM lab3), same AS MATERIALIZED (SELECT s.mesh_id, s.a, s.b FROM (SELECT mesh_id, a, b FROM dual UNION SELECT mesh_id, b, a FROM dual) s
      JOIN lab3 p ON p.mesh_id = s.mesh_id AND p.fid = s.a JOIN lab3 q ON q.mesh_id = s.mesh_id AND q.fid = s.b WHERE p.region = q.region),
    root(mesh_id, fid, island) USING KEY (mesh_id, fid) AS (SELECT mesh_id, fid, fid FROM lab3 UNION SELECT n.mesh_id, n.fid, n.island FROM (SELECT e.mesh_id, e.b AS fid, min(r.island) AS island FROM root r JOIN same e ON e.mesh_id = r.mesh_id AND e.a = r.fid GROUP BY e.mesh_id, e.b) n
      JOIN recurring.root o ON o.mesh_id = n.mesh_id AND o.fid = n.fid WHERE n.island < o.island)"""
#: Labels with islands: every seventh face of a band is given to another one.
_PATCHY = f"CASE WHEN fid % 7 = 0 THEN ({REGION} + 1) % 3 ELSE {REGION} END"


@query(D.with_mesh(SEGMENTS).replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_DUAL}, lab3 AS MATERIALIZED (SELECT mesh_id, fid, area, {_PATCHY} AS region FROM geom), {_ISLANDS},
    sized AS (SELECT r.mesh_id, l.region, r.island, sum(l.area) AS area FROM root r JOIN lab3 l ON l.mesh_id = r.mesh_id AND l.fid = r.fid GROUP BY r.mesh_id, l.region, r.island),
    kept AS (SELECT mesh_id, region, island FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, region ORDER BY area DESC, island) AS k FROM sized) q WHERE k = 1)
    SELECT l.mesh_id, l.fid, l.region, r.island, k.island = r.island AS keeper FROM lab3 l JOIN root r ON r.mesh_id = l.mesh_id AND r.fid = l.fid JOIN kept k ON k.mesh_id = l.mesh_id AND k.region = l.region""")
def label_islands(spark, sf_dir):
    """Connected parts of each label, and which part of it is the largest."""
    w, _, dual = _graph(spark, sf_dir)
    return P.islands(dual, w.face.select("mesh_id", "fid", F.expr(_PATCHY).alias("region")), w.face)


@query(_LAB.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {_DUAL}, inside AS MATERIALIZED (SELECT e.mesh_id, p.region, e.a, e.b, sum(e.cost) AS cost FROM (SELECT mesh_id, a, b, cost FROM cost UNION ALL SELECT mesh_id, b, a, cost FROM cost) e
      JOIN lab p ON p.mesh_id = e.mesh_id AND p.fid = e.a JOIN lab q ON q.mesh_id = e.mesh_id AND q.fid = e.b WHERE p.region = q.region GROUP BY e.mesh_id, p.region, e.a, e.b),
    far(mesh_id, source, fid, dist) USING KEY (mesh_id, source, fid) AS (SELECT mesh_id, fid, fid, CAST(0 AS DOUBLE) FROM lab UNION SELECT n.mesh_id, n.source, n.fid, n.dist
      FROM (SELECT r.mesh_id, r.source, e.b AS fid, min(r.dist + e.cost) AS dist FROM far r JOIN inside e ON e.mesh_id = r.mesh_id AND e.a = r.fid GROUP BY r.mesh_id, r.source, e.b) n
      LEFT JOIN recurring.far o ON o.mesh_id = n.mesh_id AND o.source = n.source AND o.fid = n.fid WHERE n.dist < coalesce(o.dist, CAST('Infinity' AS DOUBLE))),
    total AS (SELECT f.mesh_id, l.region, f.source, count(*) AS reached, sum(f.dist) AS dist FROM far f JOIN lab l ON l.mesh_id = f.mesh_id AND l.fid = f.source GROUP BY f.mesh_id, l.region, f.source),
    size AS (SELECT mesh_id, region, count(*) AS n FROM lab GROUP BY mesh_id, region)
    SELECT mesh_id, region, source AS fid FROM (SELECT t.*, row_number() OVER (PARTITION BY t.mesh_id, t.region ORDER BY CASE WHEN reached = n THEN dist ELSE CAST('Infinity' AS DOUBLE) END, source) AS k FROM total t JOIN size s ON s.mesh_id = t.mesh_id AND s.region = t.region) q WHERE k = 1""")
def region_medoids(spark, sf_dir):
    w, comp, dual = _graph(spark, sf_dir)
    return P.medoids(w, comp, dual, _label(w.face))


@query()
def dumped_orphans(spark, sf_dir):
    """Labels with islands: every seventh face of a band is given to the next one."""
    w, comp, dual = _graph(spark, sf_dir)
    return P.dump_orphans(w, comp, dual, w.face.select("mesh_id", "fid", F.expr(_PATCHY).alias("region")))[0]


@query()
def refined_faces(spark, sf_dir):
    mesh = _segments(spark, sf_dir)
    face = P.refine(mesh, mesh.vertex.select("mesh_id").distinct().withColumn("a_max", F.lit(0.4))).face
    return face.select("mesh_id", "fid", "v", "source_fid", "material")


@query(D.with_mesh(SEGMENTS) + f" SELECT mesh_id, fid AS source_fid, {s6('area', 'area')} FROM geom")
def refined_areas(spark, sf_dir):
    """Refinement with texture coordinates equal to positions: what a face is cut into has its area, in space and in the texture."""
    mesh = _segments(spark, sf_dir)
    uv = mesh.vertex.select("mesh_id", F.col("vid").alias("tid"), F.col("x").alias("u"), F.col("y").alias("v"))
    new = P.refine(Mesh(mesh.vertex, mesh.face.withColumn("t", F.col("v")), uv), mesh.vertex.select("mesh_id").distinct().withColumn("a_max", F.lit(0.4)))
    rows = I.with_geometry(new.face, new.vertex)
    each = new.face.select("mesh_id", "fid", F.posexplode("t").alias("c", "tid")).join(new.uv, ["mesh_id", "tid"]).select("mesh_id", "fid", "c", "u", F.col("v").alias("tv"))
    same = new.face.select("mesh_id", "fid", F.posexplode("v").alias("c", "vid")).join(new.vertex, ["mesh_id", "vid"]).join(each, ["mesh_id", "fid", "c"]).groupBy("mesh_id", "fid").agg(F.max(F.abs(F.col("x") - F.col("u")) + F.abs(F.col("y") - F.col("tv"))).alias("off"))
    small = rows.join(same, ["mesh_id", "fid"]).where("area <= 0.4 and off < 1e-9")
    return small.groupBy("mesh_id", "source_fid").agg(r6(F.sum("area"), "area"))


_EIG = """cov AS (SELECT mesh_id, region, count(*) AS faces, sum(area) AS area, covar_pop(cx, cx) AS xx, covar_pop(cy, cy) AS yy, covar_pop(cz, cz) AS zz, covar_pop(cx, cy) AS xy, covar_pop(cx, cz) AS xz, covar_pop(cy, cz) AS yz FROM lab GROUP BY mesh_id, region),
    e1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM cov), e2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM e1),
    e3 AS (SELECT *, ((xx - q) / p * ((yy - q) / p * (zz - q) / p - yz / p * yz / p) - xy / p * (xy / p * (zz - q) / p - yz / p * xz / p) + xz / p * (xy / p * yz / p - (yy - q) / p * xz / p)) / 2 AS r FROM e2),
    e4 AS (SELECT *, acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), r))) / 3 AS phi FROM e3), e5 AS (SELECT *, q + 2 * p * cos(phi) AS high, q + 2 * p * cos(phi + 2.0943951023931953) AS low FROM e4),
    regions AS (SELECT mesh_id, region, faces, area, high / greatest(3 * q - high - low, high * 1e-9, 1e-300) AS elongation FROM e5)"""


@query(f"{_LAB}, {_EIG} SELECT mesh_id, region, faces, {s6('area', 'area')}, {s6('elongation', 'elongation')} FROM regions")
def region_measures(spark, sf_dir):
    w = _working(_segments(spark, sf_dir))
    label = _label(w.face)
    return C.region_table(w.face, label, label.select("mesh_id", "region").distinct()).select("mesh_id", "region", "faces", r6("area"), r6("elongation"))


@query(f"""{_LAB}, {_EIG}, seam AS (SELECT s.mesh_id, sum(sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) AS seam FROM (SELECT s.mesh_id, lo, hi FROM side s JOIN lab l ON l.mesh_id = s.mesh_id AND l.fid = s.fid GROUP BY s.mesh_id, lo, hi HAVING count(DISTINCT region) > 1) s
      JOIN vert p ON p.mesh_id = s.mesh_id AND p.vid = lo JOIN vert q ON q.mesh_id = s.mesh_id AND q.vid = hi GROUP BY s.mesh_id),
    diag AS (SELECT mesh_id, sqrt(power(max(x) - min(x), 2) + power(max(y) - min(y), 2) + power(max(z) - min(z), 2)) AS diag FROM vert GROUP BY mesh_id),
    abar AS (SELECT mesh_id, sum(area) / 6 AS abar FROM geom GROUP BY mesh_id),
    dev AS (SELECT r.mesh_id, max(abs(area - abar) / abar) AS deviation, avg(least(elongation, 20)) AS rho FROM regions r JOIN abar b ON b.mesh_id = r.mesh_id GROUP BY r.mesh_id)
    SELECT d.mesh_id, {s6('deviation', 'deviation')}, {s6('seam', 'seam')}, {s6('deviation + seam / diag + (rho - 1) / 19', 'score')} FROM dev d JOIN seam s ON s.mesh_id = d.mesh_id JOIN diag g ON g.mesh_id = d.mesh_id""")
def label_scores(spark, sf_dir):
    w = _working(_segments(spark, sf_dir))
    label = _label(w.face)
    return C.scores(w, label, label.select("mesh_id", "region").distinct(), _abar(w.face, 6)).select("mesh_id", r6("deviation"), r6("seam"), r6("score"))


_PIECE = f"""{_LAB}, used AS (SELECT DISTINCT l.mesh_id, region AS piece, vid, x, y, z FROM lab l JOIN vert v ON v.mesh_id = l.mesh_id AND v.vid IN (l.a, l.b, l.c)),
    boxes AS (SELECT mesh_id, piece, count(*) AS vertices, min(x) AS lox, min(y) AS loy, min(z) AS loz, max(x) AS hix, max(y) AS hiy, max(z) AS hiz FROM used GROUP BY mesh_id, piece)"""


def _pieces(spark, sf_dir):
    w = _working(_segments(spark, sf_dir))
    return w, C.extract(w, _label(w.face))


@query(f"{_PIECE} SELECT b.mesh_id, b.piece, faces, vertices, {s6('area', 'area')}, {s6('lox', 'lox')}, {s6('hiz', 'hiz')}, {s6('(lox + hix) / 2', 'bx')}, {s6('sx / area', 'ax')} FROM boxes b JOIN (SELECT mesh_id, region, count(*) AS faces, sum(area) AS area, sum(cx * area) AS sx FROM lab GROUP BY mesh_id, region) l ON l.mesh_id = b.mesh_id AND l.region = b.piece")
def piece_stats(spark, sf_dir):
    return C.piece_table(_pieces(spark, sf_dir)[1]).select("mesh_id", "piece", "faces", "vertices", *[r6(c) for c in ("area", "lox", "hiz", "bx", "ax")])


@query(f"""{_PIECE} SELECT p.mesh_id, p.piece AS piece_a, q.piece AS piece_b, {s6('(p.lox + p.hix) / 2 - (q.lox + q.hix) / 2', 'ox')} FROM boxes p JOIN boxes q ON q.mesh_id = p.mesh_id AND q.piece <> p.piece
    AND p.lox - 0.01 <= q.hix AND q.lox <= p.hix + 0.01 AND p.loy - 0.01 <= q.hiy AND q.loy <= p.hiy + 0.01 AND p.loz - 0.01 <= q.hiz AND q.loz <= p.hiz + 0.01""")
def piece_adjacency(spark, sf_dir):
    return C.piece_adjacency(C.piece_table(_pieces(spark, sf_dir)[1])).select("mesh_id", "piece_a", "piece_b", r6("ox"))


@query(f"{_PIECE} SELECT l.mesh_id, l.fid, l.region AS piece, a.k AS va, b.k AS vb, c.k AS vc FROM lab l " + " ".join(f"JOIN (SELECT mesh_id, piece, vid, row_number() OVER (PARTITION BY mesh_id, piece ORDER BY vid) - 1 AS k FROM used) {n} ON {n}.mesh_id = l.mesh_id AND {n}.piece = l.region AND {n}.vid = l.{n}" for n in "abc"))
def extracted_faces(spark, sf_dir):
    return _pieces(spark, sf_dir)[1].face.select("mesh_id", "fid", "piece", *[F.col("v")[k].alias(f"v{n}") for k, n in enumerate("abc")])


@query(f"{_PIECE} SELECT mesh_id, sum(n) AS vertices, max(piece) AS last_piece FROM (SELECT mesh_id, piece, CAST(count(*) AS BIGINT) AS n FROM used GROUP BY mesh_id, piece) q GROUP BY mesh_id".replace("sum(n)", "CAST(sum(n) AS BIGINT)"))
def merged_pieces(spark, sf_dir):
    face, vertex = C.merge_faces(_pieces(spark, sf_dir)[1])
    return vertex.groupBy("mesh_id").agg((F.max("vid") + 1).alias("vertices")).join(face.groupBy("mesh_id").agg(F.max("piece").alias("last_piece")), "mesh_id")


@query(f"""{_PIECE} SELECT p.mesh_id, p.piece, c.faces, d.us AS uvs, {s6('d.su', 'su')}, c.faces AS normals, {s6('c.sn', 'sn')} FROM boxes p
    JOIN (SELECT mesh_id, region, count(*) AS faces, sum(nz) AS sn FROM lab GROUP BY mesh_id, region) c ON c.mesh_id = p.mesh_id AND c.region = p.piece
    JOIN (SELECT mesh_id, piece, count(*) AS us, sum(x) AS su FROM used GROUP BY mesh_id, piece) d ON d.mesh_id = p.mesh_id AND d.piece = p.piece""")
def extracted_attributes(spark, sf_dir):
    """Texture coordinates by vertex and normals by face go with the pieces, each with an index of its own."""
    w = _working(_segments(spark, sf_dir))
    uv = w.vertex.select("mesh_id", (F.col("vid") * 7).alias("tid"), F.col("x").alias("u"), F.col("y").alias("v"))
    normal = w.face.select("mesh_id", (F.col("fid") + 5).alias("nid"), "nx", "ny", "nz")
    face = w.face.withColumn("t", F.transform("v", lambda v: v * 7)).withColumn("n", F.array(*[F.col("fid") + 5] * 3))
    pieces = C.extract(I.Working(w.vertex, face, None, None, uv, normal), _label(w.face))
    faces = pieces.face.groupBy("mesh_id", "piece").agg(F.count("*").alias("faces"), F.max(F.array_max("t")).alias("last_t"), F.max(F.array_max("n")).alias("last_n"))
    own = pieces.uv.groupBy("mesh_id", "piece").agg(F.sum("u").alias("su"))
    turned = pieces.normal.groupBy("mesh_id", "piece").agg(F.sum("nz").alias("sn"))
    rows = faces.join(own, ["mesh_id", "piece"]).join(turned, ["mesh_id", "piece"])
    return rows.select("mesh_id", "piece", "faces", (F.col("last_t") + 1).alias("uvs"), r6("su"), (F.col("last_n") + 1).alias("normals"), r6("sn"))


_HLS = lambda turn: f"CASE WHEN h{turn} < 1 / 6.0 THEN low + (high - low) * h{turn} * 6 WHEN h{turn} < 0.5 THEN high WHEN h{turn} < 2 / 3.0 THEN low + (high - low) * (2 / 3.0 - h{turn}) * 6 ELSE low END"


@query(f"""{_PIECE} SELECT mesh_id, piece, {s6(_HLS('r'), 'r')}, {s6(_HLS('g'), 'g')}, {s6(_HLS('b'), 'b')} FROM (SELECT *, CAST(0.8425 AS DOUBLE) AS high, CAST(0.2575 AS DOUBLE) AS low, h + 1 / 3.0 - floor(h + 1 / 3.0) AS hr, h AS hg, h - 1 / 3.0 - floor(h - 1 / 3.0) AS hb
    FROM (SELECT mesh_id, piece, piece * CAST(0.618033988749895 AS DOUBLE) - floor(piece * CAST(0.618033988749895 AS DOUBLE)) AS h FROM boxes) p) q""")
def piece_colours(spark, sf_dir):
    rows = _pieces(spark, sf_dir)[1].face.select("mesh_id", "piece").distinct()
    r, gr, b = g.piece_color(F.col("piece"))
    return rows.select("mesh_id", "piece", r6(r, "r"), r6(gr, "g"), r6(b, "b"))


@query(f"""{_PIECE}, met AS (SELECT p.mesh_id, count(*) AS neighbours FROM boxes p JOIN boxes q ON q.mesh_id = p.mesh_id AND q.piece <> p.piece AND p.lox - 0.01 <= q.hix AND q.lox <= p.hix + 0.01 AND p.loy - 0.01 <= q.hiy AND q.loy <= p.hiy + 0.01 AND p.loz - 0.01 <= q.hiz AND q.loz <= p.hiz + 0.01 GROUP BY p.mesh_id),
    whole AS (SELECT mesh_id, (max(z) + min(z)) / 2 AS mz, max(x) - min(x) AS ex FROM vert GROUP BY mesh_id)
    SELECT b.mesh_id, b.piece, b.vertices, count(*) OVER (PARTITION BY b.mesh_id) AS piece_count, coalesce(met.neighbours, 0) AS neighbours, {s6('(b.loz + b.hiz) / 2', 'z')}, {s6('whole.mz', 'mesh_z')}, {s6('whole.ex', 'extent')}, 'normalized.glb' AS source FROM boxes b LEFT JOIN met ON met.mesh_id = b.mesh_id JOIN whole ON whole.mesh_id = b.mesh_id""")
def manifest_fields(spark, sf_dir):
    """What the JSON manifest says, read back from its text."""
    w, pieces = _pieces(spark, sf_dir)
    shape = "struct<piece_count: bigint, total_bounds: struct<center: array<double>, extents: array<double>>, piece_centroids: array<array<double>>, adjacency: array<struct<piece_a: bigint>>, source: string, piece_vertex_counts: array<bigint>>"
    rows = C.checkpoint_json(w.vertex, pieces).select("mesh_id", F.from_json("json", shape).alias("j"))
    each = rows.select("mesh_id", "j", F.posexplode(F.arrays_zip("j.piece_centroids", "j.piece_vertex_counts")).alias("piece", "p"))
    return each.select("mesh_id", F.col("piece").cast("long").alias("piece"), F.col("p.piece_vertex_counts").alias("vertices"), F.col("j.piece_count").alias("piece_count"), F.size("j.adjacency").cast("long").alias("neighbours"), r6(F.col("p.piece_centroids")[2], "z"), r6(F.col("j.total_bounds.center")[2], "mesh_z"), r6(F.col("j.total_bounds.extents")[0], "extent"), F.col("j.source").alias("source"))


@query()
def checkpoint_manifest(spark, sf_dir):
    w, pieces = _pieces(spark, sf_dir)
    return C.checkpoint_json(w.vertex, pieces)


@query(f"{_LAB} SELECT mesh_id, region AS piece, count(*) OVER (PARTITION BY mesh_id) AS n, {s6('(region % 3 + 0.5) * 34 / 128', 'u')}, {s6('1 - (CAST(floor(region / 3) AS BIGINT) + 0.5) * 34 / 128', 'v')} FROM (SELECT DISTINCT mesh_id, region FROM lab) q")
def colour_atlas(spark, sf_dir):
    """At six pieces a mesh: three columns, 128 pixels."""
    label = _label(_segments(spark, sf_dir).face)
    return C.atlas(label.select("mesh_id", F.col("region").alias("piece")).distinct()).select("mesh_id", "piece", "n", r6("u"), r6("v"))


def _numbered(lines: DataFrame) -> DataFrame:
    return lines.select("mesh_id", F.row_number().over(Window.partitionBy("mesh_id").orderBy("part", "id")).alias("line"), F.col("line").alias("value"))


@query(D.with_mesh(SEGMENTS) + f" SELECT mesh_id, fid, a AS va, b AS vb, c AS vc, {s6('z0', 'z0')}, {s6('z2', 'z2')} FROM corner")
def obj_round_trip(spark, sf_dir):
    """Written as OBJ lines and read again."""
    back = obj.parse(_numbered(sinks.obj_lines(_segments(spark, sf_dir))))
    rows = I.with_corners(back.face, back.vertex)
    return rows.select("mesh_id", "fid", *[F.col("v")[k].alias(f"v{n}") for k, n in enumerate("abc")], r6(F.col("p")[0]["z"], "z0"), r6(F.col("p")[2]["z"], "z2"))


_PLACE = lambda c: f"CAST(CASE WHEN s % 4 IN ({c}) THEN "


@query(D.with_mesh(SEGMENTS) + f""" SELECT mesh_id, s AS fid, a AS va, b AS vb, c AS vc, {_PLACE('0, 2')} a END AS BIGINT) AS ta, {_PLACE('0, 2')} c END AS BIGINT) AS tc, {_PLACE('1, 2')} b END AS BIGINT) AS nb, CAST(floor(s / 10) AS BIGINT) % 3 AS material
    FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id ORDER BY fid) - 1 AS s FROM face) f""")
def obj_attributes(spark, sf_dir):
    """Text with all forms of a corner, indices that count back, comments and materials, read as faces."""
    mesh = _segments(spark, sf_dir)
    text = lambda rows, part, key, line, sub=0: rows.select("mesh_id", F.lit(part).alias("part"), F.col(key).cast("long").alias("id"), F.lit(sub).alias("sub"), line.alias("line"))
    number = lambda c: F.col(c).cast("string")
    points = text(mesh.vertex, 0, "vid", F.concat_ws("  ", F.lit("v"), *map(number, "xyz")))
    uvs = text(mesh.vertex, 1, "vid", F.concat_ws(" ", F.lit("vt"), number("x"), number("y")))
    normals = text(mesh.vertex, 2, "vid", F.lit("vn 0 0 1"))
    count = mesh.vertex.groupBy("mesh_id").agg(F.count("*").alias("points"))
    faces = mesh.face.withColumn("s", F.row_number().over(Window.partitionBy("mesh_id").orderBy("fid")) - 1).join(count, "mesh_id")

    def corner(k: int) -> Column:
        v = F.when(F.col("s") % 2 == 1, F.col("v")[k] - F.col("points")).otherwise(F.col("v")[k] + 1).cast("string")
        form = F.col("s") % 4
        return F.when(form == 0, F.concat_ws("/", v, v)).when(form == 1, F.concat(v, F.lit("//"), v)).when(form == 2, F.concat_ws("/", v, v, v)).otherwise(v)

    used = text(faces.where("s % 10 = 0"), 3, "s", F.concat(F.lit("usemtl m"), (F.floor(F.col("s") / 10) % 3).cast("string")), 0)
    notes = text(faces.where("s % 10 = 5"), 3, "s", F.lit("# a note"), 0)
    rows = points.union(uvs).union(normals).union(used).union(notes).union(text(faces, 3, "s", F.concat_ws(" ", F.lit("f"), *map(corner, range(3))), 1))
    lines = rows.select("mesh_id", F.row_number().over(Window.partitionBy("mesh_id").orderBy("part", "id", "sub")).alias("line"), F.col("line").alias("value"))
    return obj.parse(lines).face.select("mesh_id", "fid", *[F.col("v")[k].alias(f"v{c}") for k, c in enumerate("abc")], F.col("t")[0].alias("ta"), F.col("t")[2].alias("tc"), F.col("n")[1].alias("nb"), "material")


_POINTS = "SELECT CAST(label AS BIGINT) AS mesh_id, vec_id, CAST(embedding[{0}] AS DOUBLE) AS x, CAST(embedding[{1}] AS DOUBLE) AS y, CAST(embedding[{2}] AS DOUBLE) AS z FROM embeddings WHERE label IS NOT NULL"


def _points(spark, sf_dir) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("label is not null")
    return rows.select(F.col("label").cast("long").alias("mesh_id"), "vec_id", *[F.col("embedding")[k].cast("double").alias(a) for k, a in enumerate("xyz")])


@query(f"WITH p AS ({_POINTS.format(1, 2, 3)}) SELECT a.mesh_id, a.vec_id AS a, b.vec_id AS b FROM p a JOIN p b ON b.mesh_id = a.mesh_id AND a.vec_id < b.vec_id WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) <= 0.03")
def range_join(spark, sf_dir):
    p = _points(spark, sf_dir)
    right = p.select("mesh_id", F.col("vec_id").alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    near = F.lit(0.03)
    return S.distance_join(p.withColumnRenamed("vec_id", "a"), right, near, near).where("a < b").select("mesh_id", "a", "b")


@query(f"WITH p AS ({_POINTS.format(1, 2, 3)}), d AS (SELECT a.mesh_id, a.vec_id, b.vec_id AS near, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS far FROM p a JOIN p b ON b.mesh_id = a.mesh_id AND b.vec_id <> a.vec_id) SELECT mesh_id, vec_id, near, {s6('far', 'distance')} FROM (SELECT *, row_number() OVER (PARTITION BY mesh_id, vec_id ORDER BY far, near) AS k FROM d) q WHERE k = 1")
def nearest_other_vertex(spark, sf_dir):
    """For each point the nearest one of all others with its label."""
    p = _points(spark, sf_dir)
    right = p.select("mesh_id", F.col("vec_id").alias("near"), F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    return S.nearest(p, right, "vec_id", "near", others=True).select("mesh_id", "vec_id", "near", r6("distance"))


@query(f"WITH p AS ({_POINTS.format(1, 2, 3)}) SELECT mesh_id, {s6('quantile_cont(x, 0.99)', 'p99')}, count(*) AS n FROM p GROUP BY mesh_id")
def percentiles(spark, sf_dir):
    return _points(spark, sf_dir).groupBy("mesh_id").agg(r6(F.percentile("x", 0.99), "p99"), F.count("*").alias("n"))
