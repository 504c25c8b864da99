"""Properties of the mesh operators on small meshes built here."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from meshloom.functions import geometry as g
from meshloom.operators import bridges as B
from meshloom.operators import dual as U
from meshloom.operators import ingest as I
from meshloom.operators import kernels as K
from meshloom.operators import partition as P
from meshloom.operators import pieces as C
from meshloom.operators import spatial as S
from meshloom.operators import triage as T
from meshloom.operators.graph import shortest_paths
from meshloom.plans import pipeline
from meshloom.schema import FACE, VERTEX, Mesh
from meshloom.sources import obj, sinks
from meshloom.streaming.progress import PHASES, Progress


def mesh_of(spark, points, faces, mesh_id=0):
    v = spark.createDataFrame([(mesh_id, i, *map(float, p)) for i, p in enumerate(points)], VERTEX)
    return Mesh(v, spark.createDataFrame([(mesh_id, i, list(f), None, None, 0) for i, f in enumerate(faces)], FACE))


def box(half, at=(0, 0, 0), first=0):
    points = [tuple(at[k] + s[k] * half[k] for k in range(3)) for s in [(a, b, c) for a in (-1, 1) for b in (-1, 1) for c in (-1, 1)]]
    quads = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
    return points, [tuple(first + i for i in t) for a, b, c, d in quads for t in ((a, b, c), (a, c, d))]


def strip(n, width=0.2, length=10.0):
    points = [(length * i / n, y, 0.0) for i in range(n + 1) for y in (0.0, width)]
    return points, [f for i in range(n) for f in ((2 * i, 2 * i + 2, 2 * i + 1), (2 * i + 1, 2 * i + 2, 2 * i + 3))]


def test_ingest_purges_welds_and_counts(spark):
    # two triangles that share an edge by position only, a degenerate face, an unused vertex
    points = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (5, 5, 5)]
    w = I.ingest(mesh_of(spark, points, [(0, 1, 2), (3, 4, 5), (0, 0, 1)]))
    s = w.stats.first()
    assert (s.original_face_count, s.degenerate_face_count, s.surviving_face_count, s.original_vertex_count, s.welded_vertex_count) == (3, 1, 2, 7, 5)
    assert math.isclose(s.area_before, s.area_after) and math.isclose(s.area_after, 1.0)
    assert {r.kind: r["count"] for r in I.edge_incidence(w.face).groupBy("kind").count().collect()} == {"boundary": 4, "manifold": 1}
    assert [r.source_fid for r in w.face.orderBy("fid").collect()] == [0, 1]


def test_weld_is_transitive_inclusive_and_can_be_off(spark):
    mesh = mesh_of(spark, [(0, 0, 0), (0.5, 0, 0), (1, 0, 0), (3, 0, 0)], [(0, 1, 2)])
    on = mesh.vertex.select("mesh_id").distinct().withColumn("delta", F.lit(0.5))
    vertex, mapping = I.weld(mesh.vertex, on)
    assert sorted((r.old_vid, r.vid) for r in mapping.collect()) == [(0, 0), (1, 0), (2, 0), (3, 1)]
    assert vertex.where("vid = 0").first().x == 0.5
    assert I.weld(mesh.vertex, on.withColumn("delta", F.lit(0.0)))[0].count() == 4


def test_nan_area_is_degenerate_and_zero_extent_survives_normalize(spark):
    mesh = mesh_of(spark, [(float("nan"), 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 0)], [(0, 1, 2), (3, 1, 2)])
    assert [r.source_fid for r in I.ingest(mesh, 0.0, 1e-9).face.collect()] == [1]
    assert [tuple(r)[2:] for r in I.normalize(mesh_of(spark, [(2, 3, 4)], [])).vertex.collect()] == [(0.0, 0.0, 0.0)]


@pytest.mark.parametrize(("q", "want"), [((0.2, 0.2, 3), 3), ((-3, -4, 0), 5), ((4, 0, 0), 3), ((0, 3, 0), 2), ((0.5, -2, 0), 2), ((-2, 0.5, 0), 2), ((1, 1, 0), math.sqrt(0.5))])
def test_closest_distance_in_every_region(spark, q, want):
    row = spark.createDataFrame([(*map(float, q), [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0)])], "x double, y double, z double, p array<struct<x:double,y:double,z:double>>")
    assert math.isclose(g.with_closest_distance(row, g.point(""), F.col("p"), "d").first().d, want)


def test_apportion_largest_remainder(spark):
    rows = spark.createDataFrame([(0, 0, 7.0, 6), (0, 1, 2.0, 6), (0, 2, 1.0, 6)], "mesh_id long, comp long, weight double, n_pieces int")
    assert [r.pieces for r in T.apportion(rows).orderBy("comp").collect()] == [3, 2, 1]


def test_infeasible_counts(spark):
    a, fa = box((1, 1, 1))
    b, fb = box((1, 1, 1), (10, 0, 0), 8)
    w = I.ingest(mesh_of(spark, a + b, fa + fb))
    with pytest.raises(ValueError, match="can't cover"):
        T.triage(w.face, 1)
    with pytest.raises(ValueError, match="at least"):
        T.triage(w.face, 0)


def gem(spark, at):
    a, fa = box((1, 1, 1))
    b, fb = box((0.05, 0.05, 0.05), at, 8)
    return I.ingest(mesh_of(spark, a + b, fa + fb))


def test_enclosure_promotion_and_force(spark):
    w = gem(spark, (0, 0, 0))
    comp, rows = T.triage(w.face, 3)
    wn = B.winding_numbers(rows, w.face.join(comp, ["mesh_id", "fid"]).where("comp = 0").select("mesh_id", F.col("comp").alias("other"), F.col("p").alias("op"))).first().wn
    found = B.build_bridges(w, comp, rows)
    assert abs(abs(wn) - 1) < 1e-9 and found.promoted.count() == (0 if wn > 0.5 else 1)
    far = gem(spark, (9, 0, 0))
    comp, rows = T.triage(far.face, 3)
    assert [r.comp for r in B.build_bridges(far, comp, rows).promoted.collect()] == [1]
    forced = B.build_bridges(far, comp, rows, force_exact_count=True)
    anchor = forced.anchor.first()
    assert forced.promoted.count() == 0 and anchor.forced and anchor.other == 0


@pytest.mark.parametrize(("opposite", "concave"), [((-0.5, -0.5, 0.5), False), ((1.0, -0.5, 0.5), True)])
def test_cost_of_crease(spark, opposite, concave):
    w = I.ingest(mesh_of(spark, [(0, 0, 0), (0, 1, 0), (-1, 0.5, 0), opposite], [(0, 1, 2), (1, 0, 3)]), 0.0, 0.0)
    e = U.surface_edges(w).first()
    assert e.cost > 0 and (e.a, e.b) == (0, 1) and e.concavity >= 0
    del concave


def test_nonmanifold_edges_give_all_pairs(spark):
    w = I.ingest(mesh_of(spark, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, -1, 0.1), (0, 0.1, 1)], [(0, 1, 2), (0, 1, 3), (0, 1, 4)]))
    assert sorted((r.a, r.b) for r in U.surface_edges(w).collect()) == [(0, 1), (0, 2), (1, 2)]


@pytest.fixture(scope="module")
def ribbon(spark):
    points, faces = strip(40)
    w = I.ingest(mesh_of(spark, points, faces))
    comp, rows = T.triage(w.face, 4)
    dual = U.dual_graph(w, spark.createDataFrame([], "mesh_id long, sat_face long, other_face long, dist double"))
    seeds = P.seed(w, comp, dual, rows.select("mesh_id", "comp", "pieces"))
    none = spark.createDataFrame([], "mesh_id long, sat long, other_face long")
    return w, comp, dual, seeds, none, rows.select("mesh_id", "abar")


def test_distances_two_ways(spark, ribbon):
    w, comp, dual = ribbon[:3]
    start = spark.createDataFrame([(0, 0)], "mesh_id long, fid long")
    kernel = {r.fid: r.dist for r in P.distances(w, comp, dual, start).collect()}
    rounds = {r.node: r.dist for r in shortest_paths(dual.where("a < 12 and b < 12"), start.withColumnRenamed("fid", "node")).collect()}
    assert len(kernel) == 80 and len(rounds) == 12 and all(kernel[f] == d for f, d in rounds.items())


def test_growth_covers_with_rising_keys_and_relaxation_balances(ribbon):
    labels, claims = P.grow(*ribbon)
    assert {r.region for r in labels.collect()} == {0, 1, 2, 3}
    keys = [r.key for r in claims.orderBy("seq").collect()]
    assert len(keys) == 76 and all(a <= b for a, b in zip(keys, keys[1:], strict=False))
    found = P.relax(*ribbon)
    its = found["iteration"].orderBy("it").collect()
    assert sum(r.best for r in its) == 1 and min(its, key=lambda r: (r.score, r.it)).best and its[-1].converged == (its[-1].deviation <= 0.25)
    assert found["label"].count() == 80


def test_growth_at_alpha_zero_is_voronoi():
    graph = K.graph_of(9, [(i, i + 1, 1.0) for i in range(8)])
    label, _, _ = K.grow(graph, np.ones(9), [0, 8], 4.5, np.zeros(2))
    assert label.tolist() == [0] * 5 + [1] * 4


def test_orphans_move_to_the_smallest_neighbour():
    graph = K.graph_of(6, [(i, i + 1, 1.0) for i in range(5)])
    label, size, moves = K.dump_orphans(graph, np.array([1.0, 1, 1, 1, 1, 1]), np.array([0, 0, 1, 0, 2, 2]), 3)
    assert label.tolist() == [0, 0, 1, 1, 2, 2] and moves == [(3, 0, 1)] and size.tolist() == [2, 2, 2]


def test_medoid_sample_and_unconnected():
    path = K.graph_of(2000, [(i, i + 1, 1.0) for i in range(1999)])
    assert abs(K.medoid(path, list(range(2000))) - 1000) <= 10
    assert K.medoid(K.graph_of(4, [(0, 1, 1.0), (2, 3, 1.0)]), [0, 1, 2, 3]) == 0
    assert K.farthest_points(path, [5], 3) == [5]


def test_elongation_forms_agree(spark):
    w = I.ingest(mesh_of(spark, *strip(6)))
    label = w.face.select("mesh_id", "fid", F.lit(0).cast("long").alias("region"))
    regions = spark.createDataFrame([(0, 0), (0, 1)], "mesh_id long, region long")
    rows = C.region_table(w.face, label, regions).orderBy("region").collect()
    want = K.elongation(np.array([[r.cx, r.cy, r.cz] for r in w.face.collect()]))
    assert math.isclose(rows[0].elongation, want, rel_tol=1e-6) and (rows[1].faces, rows[1].area, rows[1].elongation) == (0, 0.0, 1.0)


def test_refine_keeps_area_without_t_junctions():
    points, faces = box((1, 1, 1))
    new_points, new_faces, source, _ = K.refine(points, faces, {}, 0.4)
    area = lambda p, f: sum(0.5 * np.linalg.norm(np.cross(np.subtract(p[b], p[a]), np.subtract(p[c], p[a]))) for a, b, c in f)
    sides: dict = {}
    for f in new_faces:
        for i in range(3):
            e = tuple(sorted((f[i], f[(i + 1) % 3])))
            sides[e] = sides.get(e, 0) + 1
    assert math.isclose(area(points, faces), area(new_points, new_faces)) and set(sides.values()) == {2}
    assert max(area(new_points, [f]) for f in new_faces) <= 0.4 and set(source) == set(range(12))


def test_refine_splits_texture_per_face():
    flat, uv = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (1, 1, 0)], [(0, 0), (1, 0), (0, 1), (5, 5), (6, 5), (5, 6)]
    _, faces, _, attrs = K.refine(flat, [(0, 1, 2), (3, 2, 1)], {"uv": (uv, [(0, 1, 2), (3, 4, 5)])}, 0.3)
    values, index = attrs["uv"]
    assert len(faces) == len(index) == 4 and values[6:] == [(0.5, 0.5), (5.5, 5.5)]


def test_obj_text(spark):
    text = ["# c", "v 0 0 0", "v 1 0 0", "v 0 1 0", "vt 0 0", "f 1 2 3", "usemtl b", "f -3/1 -2 -1", "usemtl a", "f 1 2 3", "usemtl b", "f 3 2 1", "g x", ""]
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(text)], "mesh_id long, line long, value string")
    rows = obj.parse(lines).face.orderBy("fid").collect()
    assert [r.material for r in rows] == [0, 0, 1, 0] and rows[1].v == [0, 1, 2] and rows[1].t == [0, None, None] and rows[0].n is None
    with pytest.raises(Exception, match="triangle"):
        obj.parse(spark.createDataFrame([(0, 0, "f 1 2 3 4")], lines.schema)).face.collect()


def test_numbers_of_nine_digits(spark):
    values = [0.0, 1.0, 0.5, -1e-07, 123456789.123, 1e12, 0.1 + 0.2]
    rows = spark.createDataFrame([(v,) for v in values], "x double").select(sinks.nine_digits(F.col("x")).alias("s")).collect()
    assert [r.s for r in rows] == [f"{v:.9g}" for v in values]


def test_pipeline_outputs(spark, tmp_path):
    a, fa = box((1, 1, 1))
    b, fb = box((1, 1, 1), (2.2, 0, 0), 8)
    mesh = mesh_of(spark, a + b, fa + fb)
    told = []
    progress = Progress(told.append, iter(range(10**6)).__next__)
    found = pipeline.run(mesh, 4, i_max=3, progress=progress)
    assert [s["substep"]["current"] for s in told if s["substep"]] == [1, 2, 3, 4] and {s["phase"] for s in told if s["substep"]} == {"bridges"}
    assert list(progress.timings) == list(PHASES) and progress.snapshot()["done"] == progress.snapshot()["phases"]
    table = C.piece_table(found["pieces"]).orderBy("piece").collect()
    assert sum(r.faces for r in table) == 24 and len(table) == 4
    payload = json.loads(C.checkpoint_json(found["working"].vertex, found["pieces"]).first().json)
    assert payload["piece_count"] == 4 and payload["seed"] is None and list(payload)[:3] == ["piece_count", "gap", "seed"] and {(x["piece_b"], x["piece_a"]) for x in payload["adjacency"]} == {(x["piece_a"], x["piece_b"]) for x in payload["adjacency"]}
    data = bytes(sinks.pieces_glb(found["pieces"]).first().glb)
    magic, version, size = struct.unpack("<4sII", data[:12])
    names = [n["name"] for n in json.loads(data[20 : 20 + struct.unpack("<I", data[12:16])[0]])["nodes"]]
    assert magic == b"glTF" and version == 2 and size == len(data) and names[:2] == ["piece_0_front", "piece_0_back"] and len(names) == 8
    assert json.loads(sinks.merge_saved(json.dumps(payload), name="x"))["name"] == "x"
    relaxed = found["relaxed"]
    replay = sinks.replay_json(found["working"].vertex, found["working"].face, relaxed["iteration"], relaxed["iteration_label"]).first()
    iterations = json.loads(replay.iterations)
    assert len(json.loads(replay.mesh)["faces"]) == 24 and len(iterations["labels"]) == len(iterations["score"]) and 0 <= iterations["best"] < len(iterations["score"])
    result = json.loads(sinks.result_json(found["working"].face, found["label"], found["regions"], found["abar"], progress.timings).first().json)
    assert result["status"] == "done" and result["faces"] == 24 and len(result["pieces"]) == 4 and "relax" in result["timings"]
    sinks.write_puzzle_output(spark, found["working"].vertex, found["pieces"], f"{tmp_path}/out")
    assert json.loads((tmp_path / "out/0/checkpoint.json").read_text()) == payload and (tmp_path / "out/0/pieces.glb").read_bytes() == data
    sinks.write_preview_obj(found["working"].vertex, found["working"].face, found["label"], f"{tmp_path}/preview")
    assert spark.read.text(f"{tmp_path}/preview/obj").where("value like 'usemtl %'").count() == 4
    sinks.write_obj(Mesh(found["working"].vertex, found["working"].face), f"{tmp_path}/obj")
    back = spark.read.text(f"{tmp_path}/obj").where("value like 'f %'").count()
    assert back == 24


def test_progress_reports():
    seen, now = [], [0.0]
    p = Progress(seen.append, lambda: now[0])
    with pytest.raises(RuntimeError), p.stage("ingest"):
        p.substep(1, 3, "a")
        now[0] = 1.0
        p.substep(2, 3, "a")
        raise RuntimeError
    assert p.timings == {"ingest": 1.0} and [s["substep"] and s["substep"]["current"] for s in seen] == [None, 2, None]


def test_parameters():
    for bad in (("a.png", 4, 3), ("a.obj", 1, 3), ("a.obj", 4, 0), ("a.obj", 4, 51)):
        with pytest.raises(ValueError):
            pipeline.validate(*bad)
    pipeline.validate("a.OBJ", 2, 50)
    assert pipeline.request("a.obj", {}) == pipeline.Request("a.obj", 8, 15, False)
    assert pipeline.request("a.obj", {"n_pieces": "4", "max_iterations": "3", "force_exact_count": "TRUE"}) == pipeline.Request("a.obj", 4, 3, True)
    assert [pipeline.request("a.obj", {"force_exact_count": x}).force_exact_count for x in ("on", "1", "yes", "0", "")] == [True, True, False, False, False]
    for name, form in ((None, {}), ("", {}), ("a.obj", {"n_pieces": "many"}), ("a.obj", {"max_iterations": "1.5"}), ("a.obj", {"n_pieces": "1"})):
        with pytest.raises(ValueError):
            pipeline.request(name, form)


def test_nearest_of_all_others_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    points = [(1, *p) for p in rng.normal(0, 1, (150, 3))] + [(1, 1e6, 0.0, 0.0), (1, -1e9, 1.0, 0.0)] + [(1, 0.5, 0.5, 0.5)] * 4
    points += [(2, 3.0, 3.0, 3.0)] * 5 + [(3, 0.0, 0.0, 0.0)] + [(4, float(x), 0.0, 0.0) for x in range(6)]
    rows = [(m, k, float(x), float(y), float(z)) for k, (m, x, y, z) in enumerate(points)]
    left = spark.createDataFrame(rows, "mesh_id long, a long, x double, y double, z double")
    right = left.select("mesh_id", F.col("a").alias("b"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    for others in (True, False):
        got = {r.a: (r.b, r.distance) for r in S.nearest(left, right, "a", "b", others=others).collect()}
        want = {}
        for m, a, *p in rows:
            near = [(math.sqrt(sum((u - v) ** 2 for u, v in zip(p, q, strict=True))), b) for n, b, *q in rows if n == m and (b != a or not others)]
            if near:
                want[a] = (min(near)[1], pytest.approx(min(near)[0]))
        assert got == want


def test_nearest_compares_no_more_than_the_cells_around(spark, monkeypatch):
    pairs = []
    join = S.distance_join
    monkeypatch.setattr(S, "distance_join", lambda *a: pairs.append(join(*a).count()) or join(*a))
    n = 4000
    left = spark.range(2 * n).select(F.lit(1).cast("long").alias("mesh_id"), F.col("id").alias("a"), *[F.when(F.col("id") < n, F.rand(k)).otherwise(0.5).alias(c) for k, c in enumerate("xyz")]).localCheckpoint()
    right = left.select("mesh_id", F.col("a").alias("b"), *[F.col(c).alias(f"r{c}") for c in "xyz"])
    # half of the rows are copies of one
    assert S.nearest(left, right, "a", "b", others=True).count() == 2 * n and 0 < sum(pairs) < 60 * n
