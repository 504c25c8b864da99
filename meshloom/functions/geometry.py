"""Geometry as Column expressions: all of it stays inside generated code. A vector is a tuple of three Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def corner(p: Column, k: int) -> Vector:
    """Corner k of an array of three points (structs x, y, z)."""
    return p[k]["x"], p[k]["y"], p[k]["z"]


def point(prefix: str) -> Vector:
    return F.col(f"{prefix}x"), F.col(f"{prefix}y"), F.col(f"{prefix}z")


def sub(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def length(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def triangle_area(p: Column) -> Column:
    a, b, c = (corner(p, k) for k in range(3))
    return length(cross(sub(b, a), sub(c, a))) * 0.5


def centroid(p: Column) -> Vector:
    return tuple((p[0][k] + p[1][k] + p[2][k]) / 3.0 for k in "xyz")


def unit_normal(p: Column) -> Vector:
    """Of a degenerate triangle the zero vector."""
    a, b, c = (corner(p, k) for k in range(3))
    n = cross(sub(b, a), sub(c, a))
    size = length(n)
    by = F.when(size < 1e-300, F.lit(1.0)).otherwise(size)
    return tuple(x / by for x in n)


def face_extent(p: Column) -> Column:
    """The largest distance of a corner from the centroid."""
    c = centroid(p)
    return F.greatest(*[length(sub(corner(p, k), c)) for k in range(3)])


def with_closest_distance(rows: DataFrame, q: Vector, p: Column, name: str) -> DataFrame:
    """rows with the distance of a point from a triangle. The regions are tried in the order corner a, b, edge ab, corner c,
    edge ac, edge bc, inside. The steps are columns of their own, as one expression would be beyond what Java compiles."""
    a, b, c = (corner(p, k) for k in range(3))
    have = rows.columns
    vectors = {"ab": sub(b, a), "ac": sub(c, a), "aq": sub(q, a), "bq": sub(q, b), "cq": sub(q, c)}
    rows = rows.withColumns({f"__{n}{x}": v[k] for n, v in vectors.items() for k, x in enumerate("xyz")})
    v = {n: point(f"__{n}") for n in vectors}
    pairs = {"d1": ("ab", "aq"), "d2": ("ac", "aq"), "d3": ("ab", "bq"), "d4": ("ac", "bq"), "d5": ("ab", "cq"), "d6": ("ac", "cq")}
    rows = rows.withColumns({f"__{n}": dot(v[x], v[y]) for n, (x, y) in pairs.items()})
    d1, d2, d3, d4, d5, d6 = (F.col(f"__d{k}") for k in range(1, 7))
    rows = rows.withColumns({"__va": d3 * d6 - d5 * d4, "__vb": d5 * d2 - d1 * d6, "__vc": d1 * d4 - d3 * d2})
    va, vb, vc = F.col("__va"), F.col("__vb"), F.col("__vc")
    zero, one = F.lit(0.0), F.lit(1.0)
    bc = (d4 - d3) / ((d4 - d3) + (d5 - d6))
    # the nearest point is a + s ab + t ac
    place = (
        F.when((d1 <= 0) & (d2 <= 0), F.array(zero, zero))
        .when((d3 >= 0) & (d4 <= d3), F.array(one, zero))
        .when((vc <= 0) & (d1 >= 0) & (d3 <= 0), F.array(d1 / (d1 - d3), zero))
        .when((d6 >= 0) & (d5 <= d6), F.array(zero, one))
        .when((vb <= 0) & (d2 >= 0) & (d6 <= 0), F.array(zero, d2 / (d2 - d6)))
        .when((va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0), F.array(one - bc, bc))
        .otherwise(F.array(vb / (va + vb + vc), vc / (va + vb + vc)))
    )
    rows = rows.withColumn("__st", place)
    s, t = F.col("__st")[0], F.col("__st")[1]
    return rows.withColumn(name, length(tuple(v["aq"][k] - v["ab"][k] * s - v["ac"][k] * t for k in range(3)))).select(*have, name)


def solid_angle(q: Vector, p: Column) -> Column:
    """Signed solid angle of a triangle seen from a point; their sum over a surface by 4 pi is its winding number."""
    a, b, c = (sub(corner(p, k), q) for k in range(3))
    la, lb, lc = length(a), length(b), length(c)
    below = la * lb * lc + dot(a, b) * lc + dot(b, c) * la + dot(c, a) * lb
    return F.atan2(dot(a, cross(b, c)), below) * 2.0


def concavity(normal_a: Vector, normal_b: Vector, edge_point: Vector, off_edge_b: Vector) -> Column:
    """0 on a convex or flat edge, else how far the normals part."""
    s = dot(normal_a, sub(off_edge_b, edge_point))
    return F.when(s <= 0, F.lit(0.0)).otherwise(F.greatest(1.0 - dot(normal_a, normal_b), F.lit(0.0)))


def surface_cost(distance: Column, concave: Column, mu: float, least: float) -> Column:
    return F.greatest(distance * (concave * mu + 1.0), F.lit(least))


def bridge_cost(distance: Column, factor: float, least: float) -> Column:
    return F.greatest(distance * factor, F.lit(least))


def capacity_key(distance: Column, area: Column, mean_area: Column, alpha: Column, zeta: float) -> Column:
    return distance * F.pow(F.greatest(area, mean_area * zeta) / mean_area, alpha)


def off_edge_vertex(v: Column, lo: Column, hi: Column) -> Column:
    return F.element_at(F.array_except(v, F.array(lo, hi)), 1)


def corner_order_for_edge(v: Column, i: Column, j: Column) -> Column:
    """Places of the corners of v, turned so that the first two are i and j in either order."""
    at = lambda x: (F.array_position(v, x) - 1).cast("int")
    first = F.when((at(i) + 1) % 3 == at(j), at(i)).otherwise(at(j))
    return F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda k: (first + k) % 3)


def reverse_winding(v: Column) -> Column:
    return F.reverse(v)


def hsv(h: Column, s: float, v: float) -> Vector:
    """Red, green and blue in 0..1."""
    six = h * 6.0
    sector = F.floor(six) % 6
    f = six - F.floor(six)
    p, q, t = F.lit(v * (1 - s)), (1.0 - f * s) * v, (1.0 - (1.0 - f) * s) * v
    full = F.lit(v)
    pick = lambda *c: F.when(sector == 0, c[0]).when(sector == 1, c[1]).when(sector == 2, c[2]).when(sector == 3, c[3]).when(sector == 4, c[4]).otherwise(c[5])
    return pick(full, q, p, p, t, full), pick(t, full, full, q, p, p), pick(p, p, t, full, full, q)


def hls(h: Column, lightness: float, s: float) -> Vector:
    """Red, green and blue in 0..1."""
    high = lightness * (1 + s) if lightness <= 0.5 else lightness + s - lightness * s
    low = 2 * lightness - high

    def channel(turn: float) -> Column:
        x = F.pmod(h + turn, F.lit(1.0))
        return (
            F.when(x < 1 / 6, F.lit(low) + (high - low) * x * 6.0)
            .when(x < 0.5, F.lit(high))
            .when(x < 2 / 3, F.lit(low) + (high - low) * (2 / 3 - x) * 6.0)
            .otherwise(F.lit(low))
        )

    return channel(1 / 3), channel(0.0), channel(-1 / 3)


#: Step of the hue from piece to piece: the inverse golden ratio (fixed value).
HUE_STEP = 0.618033988749895


def piece_color(index: Column) -> Vector:
    return hls(F.pmod(index * HUE_STEP, F.lit(1.0)), 0.55, 0.65)


def eigenvalues(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Vector:
    """Of a symmetric 3 x 3 matrix, the smallest first (trigonometric form)."""
    q = (xx + yy + zz) / 3.0
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + (xy * xy + xz * xz + yz * yz) * 2.0
    p = F.sqrt(p2 / 6.0)
    a, b, c, d, e, f = (xx - q) / p, (yy - q) / p, (zz - q) / p, xy / p, xz / p, yz / p
    r = (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2.0
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))) / 3.0
    most = q + p * 2.0 * F.cos(phi)
    least = q + p * 2.0 * F.cos(phi + 2.0943951023931953)
    flat = p2 <= 0
    return F.when(flat, q).otherwise(least), F.when(flat, q).otherwise(q * 3.0 - most - least), F.when(flat, q).otherwise(most)


def decode_png_data_url(url: Column) -> Column:
    """Bytes of a base64 PNG data URL; null for anything else."""
    head = "data:image/png;base64,"
    return F.when(url.startswith(head), F.unbase64(F.substring(url, len(head) + 1, 2**31 - 1)))
