"""Every registered mesh query with SQL gives what DuckDB gives, on the smallest tables."""

import os

import pytest

from meshloom.plans import queries as Q

TABLES = "/root/testdata/sf0.001"
NEW = ["anchors", "bridge_edges", "forced_bridges", "promoted_pieces", "enclosed_satellites", "weld_spread", "purge_after_weld", "reversed_faces", "label_islands", "region_medoids", "refined_areas", "extracted_attributes", "piece_colours", "manifest_fields", "obj_attributes"]


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", ["face_geometry", "edge_classes", "triage_pieces", "region_measures", "extracted_faces", "obj_round_trip", "range_join", "percentiles", "nearest_other_vertex", *NEW])
def test_query_equals_sql(spark, name):
    import duckdb

    base = duckdb.connect()
    for t in ("part", "customer", "supplier", "embeddings"):
        base.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    want = base.sql(Q.ORACLE_SQL[name])
    columns = sorted(want.columns)
    df = Q.QUERIES[name](spark, TABLES)
    assert sorted(df.columns) == columns
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=repr)
    rows = sorted(([dict(zip(want.columns, r, strict=True))[c] for c in columns] for r in want.fetchall()), key=repr)
    assert got == [[pytest.approx(x, abs=2e-6) if isinstance(x, float) else x for x in r] for r in rows]


@pytest.mark.parametrize("name", ["relaxed_labels", "relaxed_iterations"])
def test_relaxation_runs_with_the_default_limit(monkeypatch, name):
    limits = []

    class Stop(Exception):
        pass

    def relax(*args, i_max=Q.P.k.I_MAX, **more):
        limits.append(i_max)
        raise Stop

    monkeypatch.setattr(Q, "_grown", lambda spark, sf_dir: ())
    monkeypatch.setattr(Q.P, "relax", relax)
    with pytest.raises(Stop):
        Q.QUERIES[name](None, TABLES)
    assert limits == [15]
