"""Meshes derived from tables, by SQL text that Spark and DuckDB both run.

A height field over the rows of a table, ordered by a dense integer key: rows of W = floor(sqrt(n)) points, the last ones as far
as the table goes, and two faces a cell wherever their corners exist. Ids carry the patch in front, so that patches of one mesh
have ids of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Mesh

#: table, key, height, mesh width of a cell, height of the floor (fixed values of the queries)
PATCHES = (
    ("part", "p_partkey", "0.02 * p_size", "1.0", "0.0"),
    ("customer", "c_custkey", "0.0001 * c_acctbal", "1.0", "200.0"),
    ("supplier", "s_suppkey", "0.000001 * s_acctbal", "0.05", "1.2"),
)
SPAN = 1_000_000_000_000


def patch_vertices(table: str, key: str, height: str, step: str, floor: str, patch: int, mesh: str = "0") -> str:
    return f"""SELECT CAST({mesh} AS BIGINT) AS mesh_id, CAST({patch} AS BIGINT) AS patch, CAST({patch * SPAN} AS BIGINT) + k AS vid, k, w, n,
      CAST(i AS DOUBLE) * CAST({step} AS DOUBLE) AS x, CAST(j AS DOUBLE) * CAST({step} AS DOUBLE) AS y, CAST({floor} AS DOUBLE) + z AS z
    FROM (SELECT k, w, n, CAST(floor(k / w) AS BIGINT) AS i, k - w * CAST(floor(k / w) AS BIGINT) AS j, z FROM (
      SELECT CAST({key} AS BIGINT) AS k, CAST(floor(sqrt((SELECT count(*) FROM {table}))) AS BIGINT) AS w, (SELECT count(*) FROM {table}) AS n, CAST({height} AS DOUBLE) AS z FROM {table}) r) g"""


def segment_vertices() -> str:
    """A mesh for each market segment."""
    return """SELECT mesh_id, CAST(0 AS BIGINT) AS patch, k AS vid, k, w, n, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y, z
    FROM (SELECT mesh_id, k, w, n, CAST(floor(k / w) AS BIGINT) AS i, k - w * CAST(floor(k / w) AS BIGINT) AS j, z FROM (
      SELECT mesh_id, row_number() OVER (PARTITION BY mesh_id ORDER BY c_custkey) - 1 AS k, CAST(floor(sqrt(count(*) OVER (PARTITION BY mesh_id))) AS BIGINT) AS w, count(*) OVER (PARTITION BY mesh_id) AS n, CAST(0.0001 * c_acctbal AS DOUBLE) AS z
      FROM (SELECT c_mktsegment, c_custkey, c_acctbal FROM customer) c JOIN (SELECT c_mktsegment AS segment, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS mesh_id FROM (SELECT DISTINCT c_mktsegment FROM customer) d) s ON c_mktsegment IS NOT DISTINCT FROM segment) r) g"""


def mesh_vertices() -> str:
    """One mesh of all patches."""
    return " UNION ALL ".join(patch_vertices(*p, patch=n) for n, p in enumerate(PATCHES))


def faces_of(vertices: str) -> str:
    """(mesh_id, patch, fid, a, b, c) over a relation of vertices."""
    cells = lambda last: f"(SELECT mesh_id, patch, vid, k, w, k - CAST(floor(k / w) AS BIGINT) AS q FROM {vertices} WHERE k + w + {last} < n AND k - w * CAST(floor(k / w) AS BIGINT) < w - 1)"
    return f"""SELECT mesh_id, patch, patch * {2 * SPAN} + 2 * q AS fid, vid AS a, vid + w AS b, vid + 1 AS c FROM {cells(0)} lower_half
    UNION ALL SELECT mesh_id, patch, patch * {2 * SPAN} + 2 * q + 1 AS fid, vid + 1 AS a, vid + w AS b, vid + w + 1 AS c FROM {cells(1)} upper_half"""


def with_mesh(vertices: str) -> str:
    """WITH clause of vert, face and geom (faces with corners, area, centroid and unit normal)."""
    d = lambda k: f"SELECT mesh_id, vid, x AS x{k}, y AS y{k}, z AS z{k} FROM vert"
    return f"""WITH vert AS MATERIALIZED ({vertices}), face AS MATERIALIZED ({faces_of('vert')}),
    corner AS (SELECT f.*, p.x0, p.y0, p.z0, q.x1, q.y1, q.z1, r.x2, r.y2, r.z2 FROM face f
      JOIN ({d(0)}) p ON p.mesh_id = f.mesh_id AND p.vid = f.a JOIN ({d(1)}) q ON q.mesh_id = f.mesh_id AND q.vid = f.b JOIN ({d(2)}) r ON r.mesh_id = f.mesh_id AND r.vid = f.c),
    crossed AS (SELECT *, (y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0) AS kx, (z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0) AS ky, (x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0) AS kz FROM corner),
    geom AS MATERIALIZED (SELECT *, sqrt(kx * kx + ky * ky + kz * kz) * CAST(0.5 AS DOUBLE) AS area, (x0 + x1 + x2) / CAST(3 AS DOUBLE) AS cx, (y0 + y1 + y2) / CAST(3 AS DOUBLE) AS cy, (z0 + z1 + z2) / CAST(3 AS DOUBLE) AS cz,
      kx / sqrt(kx * kx + ky * ky + kz * kz) AS nx, ky / sqrt(kx * kx + ky * ky + kz * kz) AS ny, kz / sqrt(kx * kx + ky * ky + kz * kz) AS nz FROM crossed),
    side AS MATERIALIZED (SELECT mesh_id, fid, patch, least(a, b) AS lo, greatest(a, b) AS hi FROM face UNION ALL SELECT mesh_id, fid, patch, least(b, c), greatest(b, c) FROM face UNION ALL SELECT mesh_id, fid, patch, least(c, a), greatest(c, a) FROM face)"""


def _views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("part", "customer", "supplier")}


def _spark_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    tables = _views(spark, sf_dir)
    for name in tables:
        text = text.replace(f"FROM {name})", "FROM {" + name + "})")
    return spark.sql(text, **{n: t for n, t in tables.items() if "{" + n + "}" in text})


def load(spark: SparkSession, sf_dir: str, vertices: str) -> Mesh:
    vert = _spark_sql(spark, sf_dir, vertices)
    face = spark.sql(f"SELECT mesh_id, fid, array(a, b, c) AS v, CAST(NULL AS array<bigint>) AS t, CAST(NULL AS array<bigint>) AS n, patch AS material FROM ({faces_of('{vert}')})", vert=vert)
    return Mesh(vert.select("mesh_id", "vid", "x", "y", "z"), face)
