import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import cluster, palette, project, region, reshape, synth, train, weights
from lattica.plans import models, regions
from lattica.sources import shape

RNG = np.random.default_rng(5)


def test_stream_finds_the_neurons_of_the_batch(spark, sf):
    cols = ["event_id", "series", "neuron_id"]
    one, two = ({tuple(r) for r in q(spark, sf).select(*cols).collect()} for q in (regions.QUERIES["msom_stream"], models.QUERIES["msom_assign"]))
    assert one == two


def test_pca_is_the_svd(spark):
    x = RNG.normal(size=(60, 5)) * [5, 3, 1, 1, 1]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "sample_id long, x array<double>")
    got = np.array([r["p"] for r in project.pca(df, 2).orderBy("sample_id").collect()])
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    want = u[:, :2] * s[:2]
    assert np.allclose(abs(got), abs(want)) and np.allclose(abs((got * want).sum(axis=0)), (want**2).sum(axis=0))


def test_sammon_lowers_the_stress():
    x = RNG.normal(size=(20, 4))
    assert project.stress(x, project.sammon(x)) < project.stress(x, x[:, :2])


def test_medoids_are_best_members():
    x = np.concatenate([RNG.normal(size=(10, 2)), RNG.normal(size=(12, 2)) + 20])
    m, label = project.k_medoids(x, 2, 1)
    assert len({*label[:10]}) == len({*label[10:]}) == 1 and label[0] != label[-1]
    for c in range(2):
        mine = np.flatnonzero(label == c)
        sums = np.linalg.norm(x[mine][:, None] - x[mine][None], axis=2).sum(axis=1)
        assert m[c] == mine[sums.argmin()]
    with pytest.raises(ValueError):
        project.k_medoids(x, 0, 1)


def test_betweenness_counts_shortest_paths():
    edges = {(0, 1), (1, 2), (0, 2), (2, 3), (3, 4), (4, 5), (3, 5)}
    assert project.betweenness(6, edges)[2, 3] == 9
    assert project.cut_by_betweenness(6, edges, 1).tolist() == [0, 0, 0, 1, 1, 1]


def test_multilevel_modularity_is_not_worse_than_greedy():
    n = 24
    a = (RNG.random((n, n)) < np.where(np.equal.outer(np.arange(n) // 8, np.arange(n) // 8), 0.7, 0.05)).astype(float)
    a = np.maximum(np.triu(a, 1), np.triu(a, 1).T)
    w = {(int(i), int(j)): 1.0 for i, j in np.argwhere(a)}
    q = lambda label: sum(a[np.ix_(label == c, label == c)].sum() / a.sum() - (a[label == c].sum() / a.sum()) ** 2 for c in set(label))
    assert q(project.multilevel_modularity(n, w)) >= q(cluster.greedy_modularity(n, w)) - 1e-9


def test_growing_map_keeps_its_grid():
    at, w = train.run_growing_som(RNG.normal(size=(200, 3)), 1, 6_000, every=50, most=30)
    assert 4 < len(w) and len({tuple(p) for p in at.tolist()}) == len(w) == (at[:, 0].max() + 1) * (at[:, 1].max() + 1)


@pytest.mark.parametrize("kind", ["tkm", "rsom"])
def test_recurrent_maps_cover_the_series(kind):
    s = synth.mackey_glass(600)[100:, None]
    w = train.run_temporal(s, 1, 2, ("rect", 4, 4), kind)
    assert abs(s - w.T).min(axis=1).mean() < s.std() / 2
    with pytest.raises(ValueError):
        train.run_temporal(s, 1, 1, ("rect", 4, 4), "other")


def test_merge_contexts_stay_in_range():
    s = synth.mackey_glass(600)[100:, None]
    for grid in (None, ("rect", 4, 4)):
        w, c = train.run_merge(s, 1, 2, 16, grid=grid)
        assert w.shape == c.shape == (16, 1) and w.min() >= s.min() and w.max() <= s.max() and c.max() <= s.max()


def test_shapefile_round_trip(spark, tmp_path):
    rings = [[(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (0.0, 0.0)], [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0), (5.0, 5.0)]]
    rows = [(0, "polygon", rings, 1.5, None), (1, "polygon", rings[:1], -2.0, 3.0)]
    df = spark.createDataFrame(rows, f"id long, kind string, rings {shape.RING}, value double, averylongname double")
    shape.write_shapefile(df, f"{tmp_path}/a", ["value", "averylongname"])
    got = shape.read_shapefiles(spark, str(tmp_path)).orderBy("id").collect()
    assert [[[tuple(p) for p in r] for r in g["rings"]] for g in got] == [rings, rings[:1]]
    assert [g["attrs"] for g in got] == [{"value": 1.5, "averylon": None}, {"value": -2.0, "averylon": 3.0}]
    shp, shx = shape.shp_bytes([("point", [[(1.0, 2.0)]]), ("point", [[(3.0, 4.0)]])])
    assert shape.parse_shp(shp) == [("point", [[(1.0, 2.0)]]), ("point", [[(3.0, 4.0)]])]
    assert struct.unpack(">i", shp[24:28])[0] * 2 == len(shp) and struct.unpack(">i", shx[24:28])[0] * 2 == len(shx)
    with pytest.raises(ValueError):
        shape.write_shapefile(df, f"{tmp_path}/b", ["value"], most_rows=1)


def test_contiguity_of_uneven_polygons(spark):
    """A long border that two shorter ones share, and a corner only."""
    sq = lambda i, x, y, a, b: (i, [(x, y), (x + a, y), (x + a, y + b), (x, y + b), (x, y)])
    df = spark.createDataFrame([sq(0, 0.0, 0.0, 2.0, 4.0), sq(1, 2.0, 0.0, 1.0, 1.0), sq(2, 2.0, 1.0, 1.0, 3.0), sq(3, 3.0, 4.0, 1.0, 1.0), sq(4, 9.0, 9.0, 1.0, 1.0)], "id long, ring array<struct<x: double, y: double>>")
    pairs = lambda rook: {tuple(r) for r in region.contiguity(df, rook).where("src < dst").collect()}
    assert pairs(True) == {(0, 1), (0, 2), (1, 2)}
    assert pairs(False) == {(0, 1), (0, 2), (1, 2), (2, 3)}


def test_local_monte_carlo_keeps_i(spark):
    v = spark.createDataFrame([(i, float(i % 5)) for i in range(30)], "id long, v double")
    w = spark.createDataFrame([(i, (i + k) % 30, 0.5) for i in range(30) for k in (1, 2)], "src long, dst long, w double")
    got = {r["id"]: r for r in weights.local_morans_i_monte_carlo(w, v, 19, 1).collect()}
    want = {r["id"]: r["i"] for r in weights.local_morans_i(w, v).collect()}
    assert len(got) == 30 and all(got[k]["i"] == want[k] and 0.05 <= got[k]["p"] <= 1 for k in want)


def test_palettes_and_classes(spark):
    for kind in palette.KINDS:
        for name in palette.names(kind):
            assert len(set(palette.palette(name, 6))) == 6
    assert palette.interpolate([0x000000, 0x0000FF], 3) == [0, 128, 255]
    with pytest.raises(ValueError):
        palette.palette("none", 3)
    v = spark.createDataFrame([(i, float(10 * (i % 3) + i / 100)) for i in range(30)], "id long, v double")
    assert {r["id"]: r["class_idx"] for r in palette.kmeans_classes(v, 3).collect()} == {i: i % 3 for i in range(30)}


def test_rows_and_names(spark):
    assert reshape.coordinate_columns(["v", "LON", "lat", "x"]) == ("LON", "lat")
    df = spark.range(100).select(F.col("id").alias("sample_id"))
    one, two = ([r[0] for r in reshape.random_rows(df, "sample_id", 10, s).collect()] for s in (1, 1))
    assert one == two and len(set(one)) == 10
    n = reshape.numbered(df, [F.col("sample_id").desc()], "n").collect()
    assert all(r["n"] == 99 - r["sample_id"] for r in n)


def test_path_to_an_unreached_node_is_empty(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 0, 1.0), (2, 3, 1.0)], "src long, dst long, w double")
    assert region.shortest_path(e, 0, 3).isEmpty()
    assert [tuple(r) for r in region.shortest_path(e, 0, 1).orderBy("step").collect()] == [(0, 0, 0.0), (1, 1, 1.0)]
