"""Sinks: OBJ, preview OBJ with its materials, GLB, manifest, replay and result JSON, merges of a saved manifest."""

from __future__ import annotations

import json
import struct

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators.pieces import Pieces, region_table
from ..schema import Mesh


def nine_digits(x: Column) -> Column:
    """Nine significant digits, without trailing zeros."""
    text = F.format_string("%.9g", x)
    text = F.when(text.contains("."), F.regexp_replace(F.regexp_replace(text, r"0+(e|$)", "$1"), r"\.(e|$)", "$1")).otherwise(text)
    return F.when(x == 0, F.lit("0")).otherwise(text)


def _numbers(tag: str, *columns: str) -> Column:
    return F.concat_ws(" ", F.lit(tag), *[nine_digits(F.col(c)) for c in columns])


def _face_line(has_t: Column, has_n: Column) -> Column:
    one = lambda name, k: F.coalesce((F.col(name)[k] + 1).cast("string"), F.lit(""))
    corner = lambda k: F.when(has_t & has_n, F.concat_ws("/", one("v", k), one("t", k), one("n", k))).when(has_t, F.concat_ws("/", one("v", k), one("t", k))).when(has_n, F.concat(one("v", k), F.lit("//"), one("n", k))).otherwise(one("v", k))
    return F.concat_ws(" ", F.lit("f"), corner(0), corner(1), corner(2))


def obj_lines(mesh: Mesh) -> DataFrame:
    """(mesh_id, part, id, line), to be sorted by these. Ids must be dense. Materials are not written."""
    rows = mesh.vertex.select("mesh_id", F.lit(0).alias("part"), F.col("vid").alias("id"), _numbers("v", "x", "y", "z").alias("line"))
    if mesh.uv is not None:
        rows = rows.union(mesh.uv.select("mesh_id", F.lit(1), "tid", _numbers("vt", "u", "v")))
    if mesh.normal is not None:
        rows = rows.union(mesh.normal.select("mesh_id", F.lit(2), "nid", _numbers("vn", "nx", "ny", "nz")))
    return rows.union(mesh.face.select("mesh_id", F.lit(3), "fid", _face_line(F.col("t").isNotNull(), F.col("n").isNotNull())))


def write_obj(mesh: Mesh, path: str) -> None:
    """A folder for each mesh with one file."""
    obj_lines(mesh).repartition("mesh_id").sortWithinPartitions("mesh_id", "part", "id").select("mesh_id", "line").write.partitionBy("mesh_id").text(path)


def preview_lines(vertex: DataFrame, face: DataFrame, label: DataFrame, library: str = "preview.mtl") -> DataFrame:
    """(mesh_id, part, region, id, line): shared vertices and an object with its material for each region that has faces."""
    rows = face.join(label, ["mesh_id", "fid"])
    heads = rows.select("mesh_id", "region").distinct()
    name = F.concat(F.lit("piece_"), F.col("region").cast("string"))
    head = heads.select("mesh_id", F.lit(2).alias("part"), "region", F.explode(F.array(F.struct(F.lit(-2).cast("long").alias("id"), F.concat(F.lit("o "), name).alias("line")), F.struct(F.lit(-1).cast("long").alias("id"), F.concat(F.lit("usemtl "), name).alias("line")))).alias("h")).select("mesh_id", "part", "region", "h.*")
    top = vertex.select("mesh_id").distinct().select("mesh_id", F.lit(0), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(f"mtllib {library}"))
    points = vertex.select("mesh_id", F.lit(1), F.lit(0).cast("long"), "vid", _numbers("v", "x", "y", "z"))
    no = F.lit(False)
    return head.union(top).union(points).union(rows.select("mesh_id", F.lit(2), "region", "fid", _face_line(no, no)))


def material_lines(regions: DataFrame) -> DataFrame:
    """regions (mesh_id, region) -> (mesh_id, region, line): the diffuse colour of each."""
    r, gr, b = g.piece_color(F.col("region"))
    return regions.select("mesh_id", "region", F.concat(F.lit("newmtl piece_"), F.col("region").cast("string"), F.lit("\n"), F.format_string("Kd %.4f %.4f %.4f", r, gr, b)).alias("line"))


def write_preview_obj(vertex: DataFrame, face: DataFrame, label: DataFrame, path: str) -> None:
    lines = preview_lines(vertex, face, label)
    lines.repartition("mesh_id").sortWithinPartitions("mesh_id", "part", "region", "id").select("mesh_id", "line").write.partitionBy("mesh_id").text(f"{path}/obj")
    material_lines(label.select("mesh_id", "region").distinct()).repartition("mesh_id").sortWithinPartitions("mesh_id", "region").select("mesh_id", "line").write.partitionBy("mesh_id").text(f"{path}/mtl")


def glb(meshes: list[tuple[str, list, list]]) -> bytes:
    """Binary glTF 2.0 of (name, points, triangles): a node and a flat mesh for each."""
    out: dict = {"asset": {"version": "2.0"}, "scene": 0, "scenes": [{"nodes": list(range(len(meshes)))}], "nodes": [], "meshes": [], "accessors": [], "bufferViews": [], "buffers": [], "materials": [{"pbrMetallicRoughness": {"baseColorFactor": [200 / 255] * 3 + [1.0]}}]}
    body = bytearray()
    for k, (name, points, triangles) in enumerate(meshes):
        out["nodes"].append({"name": name, "mesh": k})
        out["meshes"].append({"name": name, "primitives": [{"attributes": {"POSITION": 2 * k}, "indices": 2 * k + 1, "material": 0}]})
        for data, kind, code, target, count in ((b"".join(struct.pack("<3f", *p) for p in points), "VEC3", 5126, 34962, len(points)), (b"".join(struct.pack("<3I", *t) for t in triangles), "SCALAR", 5125, 34963, 3 * len(triangles))):
            view = {"buffer": 0, "byteOffset": len(body), "byteLength": len(data), "target": target}
            accessor: dict = {"bufferView": len(out["bufferViews"]), "componentType": code, "count": count, "type": kind}
            if kind == "VEC3" and points:
                single = [struct.unpack("<3f", struct.pack("<3f", *p)) for p in points]
                accessor |= {"min": [min(p[a] for p in single) for a in range(3)], "max": [max(p[a] for p in single) for a in range(3)]}
            out["bufferViews"].append(view)
            out["accessors"].append(accessor)
            body += data
    out["buffers"].append({"byteLength": len(body)})
    text = json.dumps(out, separators=(",", ":")).encode()
    text += b" " * (-len(text) % 4)
    body += b"\0" * (-len(body) % 4)
    return struct.pack("<4sII", b"glTF", 2, 28 + len(text) + len(body)) + struct.pack("<I4s", len(text), b"JSON") + text + struct.pack("<I4s", len(body), b"BIN\0") + bytes(body)


def pieces_glb(pieces: Pieces) -> DataFrame:
    """(mesh_id, glb): for each piece a front node and a back node of reversed faces. One task per mesh."""
    rows = pieces.vertex.select("mesh_id", "piece", F.col("vid").alias("id"), F.array("x", "y", "z").alias("point"), F.lit(None).cast("array<long>").alias("v")).union(pieces.face.select("mesh_id", "piece", "pfid", F.lit(None).cast("array<double>"), "v"))

    def of_mesh(frame):
        import pandas as pd

        names = sorted(frame["piece"].unique())
        width, meshes = len(str(len(names))), []
        for piece in names:
            own = frame[frame["piece"] == piece].sort_values("id")
            points = [tuple(p) for p in own["point"].dropna()]
            tri = [tuple(int(i) for i in v) for v in own["v"].dropna()]
            label = f"piece_{int(piece):0{width}d}"
            meshes += [(f"{label}_front", points, tri), (f"{label}_back", points, [t[::-1] for t in tri])]
        return pd.DataFrame({"mesh_id": [frame["mesh_id"].iloc[0]], "glb": [glb(meshes)]})

    return rows.groupBy("mesh_id").applyInPandas(of_mesh, "mesh_id long, glb binary")


def replay_json(vertex: DataFrame, face: DataFrame, iteration: DataFrame, iteration_label: DataFrame) -> DataFrame:
    """(mesh_id, mesh, iterations): positions to six places and faces; labels, scores and deviations of all iterations."""
    points = vertex.groupBy("mesh_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("vid", F.array(*[F.round(k, 6) for k in "xyz"]).alias("p")))), lambda q: q["p"]).alias("positions"))
    tri = face.groupBy("mesh_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "v"))), lambda q: q["v"]).alias("faces"))
    each = iteration_label.groupBy("mesh_id", "it").agg(F.transform(F.array_sort(F.collect_list(F.struct("fid", "region"))), lambda q: q["region"]).alias("labels")).join(iteration, ["mesh_id", "it"])
    ordered = lambda field: F.transform(F.array_sort("all"), lambda q: q[field]).alias(field)
    its = each.groupBy("mesh_id").agg(F.collect_list(F.struct("it", "labels", "score", "deviation")).alias("all"), F.min(F.when(F.col("best"), F.col("it"))).alias("best"))
    its = its.select("mesh_id", F.to_json(F.struct(ordered("labels"), ordered("score"), ordered("deviation"), "best")).alias("iterations"))
    return points.join(tri, "mesh_id").select("mesh_id", F.to_json(F.struct("positions", "faces")).alias("mesh")).join(its, "mesh_id")


def result_json(face: DataFrame, label: DataFrame, regions: DataFrame, abar: DataFrame, timings: dict[str, float]) -> DataFrame:
    """(mesh_id, json): area, deviation and faces of each piece, and the seconds of the phases."""
    rows = region_table(face, label, regions).join(abar, "mesh_id").withColumn("deviation", F.abs(F.col("area") - F.col("abar")) / F.col("abar"))
    own = rows.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("region", "area", "deviation", "faces"))).alias("pieces"), F.sum("area").alias("total_area"), F.sum("faces").alias("faces"))
    took = F.create_map(*[x for name, s in timings.items() for x in (F.lit(name), F.lit(float(s)))]) if timings else F.create_map().cast("map<string,double>")
    return own.select("mesh_id", F.to_json(F.struct(F.lit("done").alias("status"), "pieces", "total_area", "faces", took.alias("timings"))).alias("json"))


def merge_saved(manifest: str, orientation: list[float] | None = None, name: str | None = None, lowpoly_vertices: int | None = None, lowpoly_faces: int | None = None) -> str:
    """A manifest with what the user saved; all else stays, in its order."""
    payload = json.loads(manifest)
    new = {"orientation": orientation, "name": name, "lowpoly_vertices": lowpoly_vertices, "lowpoly_faces": lowpoly_faces}
    payload |= {k: v for k, v in new.items() if v is not None}
    return json.dumps(payload, indent=2)


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file by Hadoop's file systems, so that any store that Spark reaches will do; the file appears whole or not at all."""
    hadoop = spark._jvm.org.apache.hadoop
    to, part = hadoop.fs.Path(path), hadoop.fs.Path(f"{path}.part")
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    out.write(bytearray(data))
    out.close()
    fs.delete(to, False)
    if not fs.rename(part, to):
        raise OSError(f"can't rename to {path}")


def write_puzzle_output(spark: SparkSession, vertex: DataFrame, pieces: Pieces, path: str) -> None:
    """pieces.glb and checkpoint.json in a folder for each mesh. Meshes come to the driver one by one."""
    from ..operators.pieces import checkpoint_json

    for row in pieces_glb(pieces).join(checkpoint_json(vertex, pieces), "mesh_id").toLocalIterator():
        write_bytes(spark, f"{path}/{row.mesh_id}/pieces.glb", bytes(row.glb))
        write_bytes(spark, f"{path}/{row.mesh_id}/checkpoint.json", json.dumps(json.loads(row.json), indent=2).encode())
