"""Relations of the mesh model. Every relation is keyed by mesh_id, so a corpus of meshes is one set of tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

VERTEX = "mesh_id long, vid long, x double, y double, z double"
UV = "mesh_id long, tid long, u double, v double"
NORMAL = "mesh_id long, nid long, nx double, ny double, nz double"
FACE = "mesh_id long, fid long, v array<long>, t array<long>, n array<long>, material long"


@dataclass
class Mesh:
    """Positions, texture coordinates and normals are indexed independently at each corner of a face."""

    vertex: DataFrame
    face: DataFrame
    uv: DataFrame | None = None
    normal: DataFrame | None = None
