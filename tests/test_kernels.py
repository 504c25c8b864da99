"""The order-dependent steps against brute force, on random graphs and meshes and as the registered queries run them."""

import os
import random

import numpy as np
import pytest

import brute
from meshloom.operators import graph as G
from meshloom.operators import kernels as K
from meshloom.operators import partition as P
from meshloom.plans import queries as Q
from meshloom.schema import Mesh

TABLES = "/root/testdata/sf0.001"


def graphs():
    """(nodes, edges, areas): connected ones, ones in parts, with parallel edges, with costs that tie."""
    for seed in range(12):
        rng = random.Random(seed)
        n = rng.randrange(8, 26)
        cost = (lambda: float(rng.randrange(1, 4))) if seed % 3 == 0 else rng.random
        edges = [(k, rng.randrange(k), cost() + 0.01) for k in range(1, n) if seed % 4 or k != n // 2]
        edges += [(rng.randrange(n), rng.randrange(n), cost() + 0.01) for _ in range(n)]
        edges = [(a, b, c) for a, b, c in edges if a != b]
        yield n, edges + edges[:2], [float(rng.randrange(1, 5)) for _ in range(n)], rng


@pytest.mark.parametrize("case", list(graphs()), ids=lambda c: f"{c[0]} nodes")
def test_graph_steps(case):
    n, edges, area, rng = case
    graph = K.graph_of(n, edges)
    for nodes in (list(range(n)), sorted(rng.sample(range(n), n // 2))):
        for count in (1, 3, n + 2):
            assert K.farthest_points(graph, nodes, count) == brute.farthest(n, edges, nodes, count)
        assert K.medoid(graph, nodes) == brute.medoid(n, edges, nodes)
    seeds = rng.sample(range(n), 3)
    for alpha in ([0.0] * 3, [1.5] * 3, [3.0, 1.5, 2.0]):
        label, claims, _ = K.grow(graph, np.array(area), seeds, sum(area) / 3, np.array(alpha))
        want, order = brute.grow(n, edges, area, seeds, sum(area) / 3, alpha)
        assert label.tolist() == want and claims == order
    label = [rng.randrange(-1, 3) if rng.random() < 0.9 else 0 for _ in range(n)]
    assert K.islands(graph, np.array(label)).tolist() == brute.islands(n, edges, label)
    got, size, moves = K.dump_orphans(graph, np.array(area), np.array(label), 3)
    want, order = brute.dump(n, edges, area, label, 3)
    assert got.tolist() == want and moves == order and size.tolist() == [sum(a for a, x in zip(area, want, strict=True) if x == r) for r in range(3)]


def test_relaxation_of_random_graphs():
    lengths = set()
    for n, edges, area, rng in graphs():
        if len(set(brute.islands(n, edges, [0] * n))) > 1:
            continue
        points = [[rng.random() * 3, rng.random(), rng.random()] for _ in range(n)]
        sides = [(c, [a, b]) for a, b, c in edges]
        seeds, mean = brute.farthest(n, edges, list(range(n)), 3), sum(area) / 3
        records, best, balanced = K.Mesh(area, points, edges, sides, [], mean, 2.0).relax(seeds, i_max=6)
        want, place = brute.relax(n, edges, area, points, sides, seeds, mean, 2.0, i_max=6)
        assert [r["label"].tolist() for r in records] == [w[0] for w in want] and best == place and balanced == (want[-1][1] <= 0.25)
        for r, w in zip(records, want, strict=True):
            assert (r["deviation"], r["seam"], r["score"]) == pytest.approx(w[1:])
        lengths.add(len(records))
    assert len(lengths) > 1


@pytest.mark.parametrize("parts", ["1", "7"])
def test_components_of_random_graphs(spark, parts):
    """Contracted in one part, and in several whose roots are linked by rounds; ids without an order, loops and repeats."""
    rows, want = [], {}
    for m, (n, edges, _, rng) in enumerate(graphs()):
        name = rng.sample(range(10_000), n)
        rows += [(m, name[a], name[b]) for a, b, _ in edges] + [(m, name[0], name[0])]
        root = brute.islands(n, edges, [0] * n)
        want |= {(m, name[f]): min(name[g] for g in range(n) if root[g] == root[f]) for f in range(n)}
    edges, nodes = spark.createDataFrame(rows, "mesh_id long, a long, b long"), spark.createDataFrame(list(want), "mesh_id long, node long")
    settings = {"spark.sql.shuffle.partitions": parts, "spark.sql.adaptive.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        got = {(r.mesh_id, r.node): r.root for r in G.components(nodes, edges).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert got == want
    path = np.random.default_rng(1).permutation(3000)
    assert set(G.roots_of(path[:-1], path[1:], 3000).tolist()) == {0}


def random_mesh(seed):
    rng = np.random.default_rng(seed)
    n = 4
    points = [(i + rng.random() * 0.3, j + rng.random() * 0.3, rng.random()) for i in range(n) for j in range(n)]
    faces = [f for i in range(n - 1) for j in range(n - 1) for a in [i * n + j] for f in ((a, a + n, a + 1), (a + 1, a + n, a + n + 1))]
    return points, faces, [[rng.random(2) for _ in range(3)] for _ in faces]


@pytest.mark.parametrize("seed", range(4))
def test_refinement(spark, seed):
    points, faces, corners = random_mesh(seed)
    if seed == 3:  # an edge of three faces, and a second sheet
        points, faces, corners = [*points, (0.5, 0.5, 3.0)], [*faces, (faces[0][0], faces[0][1], len(points))], [*corners, corners[0]]
    want_points, want_faces, want_source, want_corners = brute.refine(points, faces, 0.15, corners)
    mesh = Mesh(
        spark.createDataFrame([(5, 10 + k, *map(float, p)) for k, p in enumerate(points)], "mesh_id long, vid long, x double, y double, z double"),
        spark.createDataFrame([(5, 100 + k, [10 + v for v in f], [3 * k + 20 + j for j in range(3)], None if k % 2 else [7, 7, 7 + k % 4], k % 3) for k, f in enumerate(faces)], "mesh_id long, fid long, v array<long>, t array<long>, n array<long>, material long"),
        spark.createDataFrame([(5, 20 + 3 * k + j, *map(float, c[j])) for k, c in enumerate(corners) for j in range(3)], "mesh_id long, tid long, u double, v double"),
        spark.createDataFrame([(5, 7, 0.0, 0.0, 1.0), (5, 9, 0.0, 1.0, 0.0)], "mesh_id long, nid long, nx double, ny double, nz double"),
    )
    out = P.refine(mesh, spark.createDataFrame([(5, 0.15)], "mesh_id long, a_max double"))
    rows = out.face.orderBy("fid").collect()
    assert [tuple(r.v) for r in rows] == want_faces and [r.source_fid - 100 for r in rows] == want_source and [r.material for r in rows] == [s % 3 for s in want_source]
    assert np.allclose([(r.x, r.y, r.z) for r in out.vertex.orderBy("vid").collect()], want_points)
    uv = {r.tid: (r.u, r.v) for r in out.uv.collect()}
    assert np.allclose([[uv[t] for t in r.t] for r in rows], want_corners)
    normal = {r.nid: np.array([r.nx, r.ny, r.nz]) for r in out.normal.collect()}
    assert all((r.n is None) == bool(s % 2) for r, s in zip(rows, want_source, strict=True)) and all(np.isclose(np.linalg.norm(x), 1) for x in normal.values())


@pytest.fixture(scope="module")
def tables(spark):
    """For each mesh of the queries: face ids, areas, centroids, edges, seam sides, diagonal."""
    if not os.path.isdir(TABLES):
        pytest.skip("no tables")
    w, _, dual = Q._graph(spark, TABLES)
    out = {}
    sides = Q.I.edge_incidence(w.face).where("n > 1").collect()
    points = {(r.mesh_id, r.vid): np.array([r.x, r.y, r.z]) for r in w.vertex.collect()}
    rows, edges = w.face.orderBy("fid").collect(), dual.collect()
    for m in {r.mesh_id for r in rows}:
        own = [r for r in rows if r.mesh_id == m]
        at = {r.fid: k for k, r in enumerate(own)}
        corners = np.array([p for (i, _), p in points.items() if i == m])
        out[m] = dict(
            fid=[r.fid for r in own], area=[r.area for r in own], centroids=[(r.cx, r.cy, r.cz) for r in own], edges=[(at[e.a], at[e.b], e.cost) for e in edges if e.mesh_id == m],
            sides=[(float(np.linalg.norm(points[m, s.lo] - points[m, s.hi])), [at[f] for f in s.faces]) for s in sides if s.mesh_id == m], diagonal=float(np.linalg.norm(corners.max(axis=0) - corners.min(axis=0))),
        )
    return out


def seeds_of(t):
    return brute.farthest(len(t["fid"]), t["edges"], list(range(len(t["fid"]))), 6)


def test_seeding_query(spark, tables):
    got = {m: [r.fid for r in sorted(rows, key=lambda r: r.region)] for m, rows in by_mesh(Q.farthest_seeds(spark, TABLES)).items()}
    assert got == {m: [t["fid"][f] for f in seeds_of(t)] for m, t in tables.items()}


def by_mesh(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.mesh_id, []).append(r)
    return out


def test_growth_query(spark, tables):
    got = by_mesh(Q.capacity_growth(spark, TABLES))
    for m, t in tables.items():
        label, claims = brute.grow(len(t["fid"]), t["edges"], t["area"], seeds_of(t), sum(t["area"]) / 6, [1.5] * 6)
        rows = sorted(got[m], key=lambda r: r.fid)
        assert [r.region for r in rows] == label
        assert [(r.fid, r.region, r.key) for r in sorted((r for r in rows if r.seq is not None), key=lambda r: r.seq)] == [(t["fid"][f], r, pytest.approx(k, abs=2e-6)) for f, r, k in claims]


def test_relaxation_queries(spark, tables):
    labels, iterations = by_mesh(Q.relaxed_labels(spark, TABLES)), by_mesh(Q.relaxed_iterations(spark, TABLES))
    for m, t in tables.items():
        records, best = brute.relax(len(t["fid"]), t["edges"], t["area"], t["centroids"], t["sides"], seeds_of(t), sum(t["area"]) / 6, t["diagonal"])
        assert [r.region for r in sorted(labels[m], key=lambda r: r.fid)] == records[best][0]
        rows = sorted(iterations[m], key=lambda r: r.it)
        assert [(r.deviation, r.seam, r.score, r.best) for r in rows] == [(*(pytest.approx(x, abs=2e-6) for x in w[1:]), k == best) for k, w in enumerate(records)]
        assert {r.converged for r in rows} == {records[-1][1] <= 0.25}


def test_dump_query(spark, tables):
    got = by_mesh(Q.dumped_orphans(spark, TABLES))
    for m, t in tables.items():
        label = [(f // 100 + 1) % 3 if f % 7 == 0 else f // 100 for f in t["fid"]]
        want, _ = brute.dump(len(t["fid"]), t["edges"], t["area"], label, max(label) + 1)
        assert [r.region for r in sorted(got[m], key=lambda r: r.fid)] == want


def test_refinement_query(spark):
    mesh = Q._segments(spark, TABLES)
    got, points = by_mesh(Q.refined_faces(spark, TABLES)), by_mesh(mesh.vertex)
    for m, rows in by_mesh(mesh.face).items():
        rows.sort(key=lambda r: r.fid)
        own = sorted(points[m], key=lambda r: r.vid)
        _, faces, source, _ = brute.refine([(p.x, p.y, p.z) for p in own], [r.v for r in rows], 0.4)
        assert [(tuple(r.v), r.source_fid) for r in sorted(got[m], key=lambda r: r.fid)] == [(f, rows[s].fid) for f, s in zip(faces, source, strict=True)]
