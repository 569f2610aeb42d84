from xml.etree import ElementTree

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica import catalog
from lattica.functions import vector as V
from lattica.operators import assign, blocks, cluster, frame, graph, synth, train, weights
from lattica.plans import models
from lattica.sources import files, text
from lattica.streaming import temporal

RNG = np.random.default_rng(3)


def hop_by_search(kind, nx, ny):
    h = train.hops(kind, nx, ny)
    near = h == 1
    dist = np.where(np.eye(len(h), dtype=bool), 0, np.inf)
    front = np.eye(len(h), dtype=bool)
    for step in range(1, nx + ny):
        front = (front @ near) & np.isinf(dist)
        dist[front] = step
    return h, dist


@pytest.mark.parametrize("kind,nx,ny", [("rect", 5, 4), ("toroid", 6, 5), ("hex", 7, 5), ("hex_toroid", 8, 6)])
def test_hops_are_shortest_paths(kind, nx, ny):
    h, dist = hop_by_search(kind, nx, ny)
    assert (h == dist).all() and (h == h.T).all()


def test_training_is_seeded_and_improves():
    x = RNG.normal(size=(300, 3))
    qe = lambda w: np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2)).min(axis=1).mean()
    for run in (lambda s, n: train.run_som(x, s, n, ("hex", 4, 4), (2.0, 0.3)), lambda s, n: train.run_ng(x, s, n, 16, (8.0, 0.01))):
        assert (run(1, 500) == run(1, 500)).all()
        assert qe(run(1, 2000)) < qe(run(1, 0))
        assert (run(2, 1000) >= x.min(axis=0) - 1e-9).all() and (run(2, 1000) <= x.max(axis=0) + 1e-9).all()
    grown = train.run_gng(x, 1, 2000, most=20)
    assert 2 < len(grown) <= 20


def test_kmeans_runs_until_it_settles(spark, sf, monkeypatch):
    x = np.arange(40.0)
    rows = spark.createDataFrame([(i, [v]) for i, v in enumerate(x.tolist())], "sample_id long, x array<double>")
    start = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "neuron_id long, w array<double>")  # 16 rounds
    monkeypatch.setattr(models, "samples", lambda spark, d: rows)
    monkeypatch.setattr(models.T, "codebook", lambda spark, d: start)
    w = np.array(sorted(r.w for r in models.QUERIES["kmeans"](spark, sf).collect()))
    best = abs(x[:, None] - w).argmin(axis=1)
    assert max(abs(x[best == k].mean() - w[k]) for k in range(4)) <= 1e-5
    with pytest.raises(RuntimeError, match="settle"):
        train.kmeans(rows, start, rounds=2)


def test_linkages_against_definitions():
    x = RNG.normal(size=(12, 2))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    direct = {
        "single": lambda a, b: d[np.ix_(a, b)].min(),
        "complete": lambda a, b: d[np.ix_(a, b)].max(),
        "average": lambda a, b: d[np.ix_(a, b)].mean(),
        "ward": lambda a, b: cluster.sum_squares(x[a + b]) - cluster.sum_squares(x[a]) - cluster.sum_squares(x[b]),
    }
    for name, cost in direct.items():
        members = {i: [i] for i in range(len(x))}
        for k, (a, b, c) in enumerate(cluster.tree(x, name)):
            assert c == pytest.approx(cost(members[a], members[b]))
            alive = [m for i, m in members.items()]
            assert c == pytest.approx(min(cost(p, q) for i, p in enumerate(alive) for q in alive[:i]))
            members[len(x) + k] = members.pop(a) + members.pop(b)


def test_cuts():
    x = np.array([[0.0], [0.1], [5.0], [5.1], [9.0]])
    assert cluster.cut_tree(5, cluster.tree(x, "ward"), 3).tolist() == [0, 0, 1, 1, 2]
    line = [(0, 1), (1, 2), (2, 3), (3, 4)]
    assert cluster.cut_edges(x, line, 3).tolist() == [0, 0, 1, 1, 2]
    with pytest.raises(ValueError):
        cluster.cut_edges(x, line, 3, least=3)
    with pytest.raises(ValueError):
        cluster.cut_tree(5, cluster.tree(x, "ward"), 6)
    assert all(len(cluster.merge_edges(x, set(line), n)) == 4 for n in cluster.LINKAGES)


def test_modularity_finds_cliques():
    e = {(a, b): 1.0 for base in (0, 4) for a in range(base, base + 4) for b in range(base, base + 4) if a != b}
    e |= {(0, 4): 1.0, (4, 0): 1.0}
    assert cluster.greedy_modularity(8, e).tolist() == [0] * 4 + [1] * 4


def test_temporal_steps():
    w, c = np.array([[0.0], [1.0]]), np.array([[0.0], [1.0]])
    assert temporal.msom_step(np.array([0.4]), w, c, None, 0.5, 0.5) == 0
    assert temporal.msom_step(np.array([0.5001]), w, c, 0, 0.9, 0.5) == 0
    assert temporal.som_sd_step(np.array([0.6]), w, np.array([[0, 0], [5, 0]]), np.array([[0, 0], [5, 0]]), 0, 0.9) == 0
    assert temporal.leaky(np.array([1.0]), w, np.zeros(2)).argmax() == 1


def test_mackey_glass_stays_bounded():
    x = synth.mackey_glass(3000)
    assert len(x) == 3001 and 0 < x.min() and x.max() < 2


@pytest.mark.parametrize("name", sorted(set(models.QUERIES) - set(models.SQL)))
def test_models_run(spark, sf, name):
    assert models.QUERIES[name](spark, sf).count() > 0


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y,s\n# note\n1,2.5,a\n,3,b\n")
    got = files.read_numeric_csv(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["x", "y"] and [tuple(r) for r in got.collect()] == [(1.0, 2.5), (None, 3.0)]
    assert files.read_mixed_csv(spark, str(tmp_path / "b.csv") if (tmp_path / "b.csv").write_text("x,s\n1,a\n2,3\n") else "").dtypes == [("x", "double"), ("s", "string")]
    edges = spark.createDataFrame([(1, 2, 0.5), (2, 1, 0.25)], "src long, dst long, w double")
    files.write_edges(edges, str(tmp_path / "e"))
    assert sorted(map(tuple, files.read_edges(spark, str(tmp_path / "e")).collect())) == [(1, 2, 0.5), (2, 1, 0.25)]
    book = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "neuron_id long, w array<double>")
    files.write_gas(book, str(tmp_path / "g"))
    assert [r.w for r in files.read_gas(spark, str(tmp_path / "g")).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    (tmp_path / "m.csv").write_text("0,1.5\n,2\n")
    assert len(files.read_square_distances(spark, str(tmp_path / "m.csv")).collect()) == 3
    lines = [r.value for r in files.graphml_lines(spark.createDataFrame([(1, 0.5)], "id long, a double"), edges).collect()]
    assert lines[0].startswith("<?xml") and lines[-1] == "</graphml>" and sum("<edge" in x for x in lines) == 2


def test_searches_take_nulls_and_ignored_neurons(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (3, [None, 1.0]), (4, [0.0, 0.0]), (5, [float("nan"), 0.0])]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>").coalesce(1)
    book = spark.createDataFrame([(0, [0.0, 0.0]), (7, [9.0, 9.0])], "neuron_id long, w array<double>")
    got = {r.sample_id: (r.neuron_id, r.dist) for r in assign.bmu_euclid(df, book).collect()}
    assert got == {1: (0, 5**0.5), 2: (None, None), 3: (None, None), 4: (0, 0.0), 5: (None, None)}
    assert {r.neuron_id for r in assign.bmu_euclid(df, book, ignore={0}).collect()} == {7, None}
    assert {r.neuron_id for r in assign.bmu_euclid(df, book, ignore={0, 7}).collect()} == {None}
    column = assign.bmu(df, book, V.euclid("x", "w"), ignore={0})
    assert {r.neuron_id for r in column.where("sample_id in (1, 4)").collect()} == {7}
    ranks = {(r.sample_id, r.neuron_id): r["rank"] for r in assign.ranked(df, book, assign.euclid()).collect()}
    assert ranks == {(1, 0): 1, (1, 7): 2, (4, 0): 1, (4, 7): 2}
    assert assign.bmu_euclid(df.limit(0), book).count() == 0 and assign.bmu_euclid(df, book.limit(0)).where("neuron_id is null").count() == 5
    with pytest.raises(Exception, match="components"):
        assign.bmu_euclid(spark.createDataFrame([(1, [1.0])], "sample_id long, x array<double>"), book).collect()
    with pytest.raises(ValueError, match="broadcast"):
        assign.small(spark.range(11), most_rows=10)
    with pytest.raises(ValueError, match="broadcast"):
        assign.small(spark.range(11), most_bytes=20)


def test_searches_exchange_no_samples(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "sample_id long, x array<double>")
    book = spark.createDataFrame([(0, [0.0, 0.0], 0, 0), (1, [9.0, 9.0], 0, 1)], "neuron_id long, w array<double>, gx int, gy int")
    for out in (assign.bmu_euclid(df, book.select("neuron_id", "w")), assign.ranked(df, book.select("neuron_id", "w"), assign.euclid())):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_epochs_against_numpy(spark):
    x, w = RNG.normal(size=(200, 3)), RNG.normal(size=(6, 3))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(999, None)], "sample_id long, x array<double>").repartition(3)
    book = spark.createDataFrame([(i, v, i // 3, i % 3) for i, v in enumerate(w.tolist())], "neuron_id long, w array<double>, gx int, gy int")
    d = ((x[:, None] - w) ** 2).sum(axis=2)
    h = np.exp(-d.argsort(axis=1).argsort(axis=1) / 2.0)
    by = lambda t: np.array([r.w for r in sorted(t.collect(), key=lambda r: r.neuron_id)])
    assert by(train.ng_epoch(df, book, 2.0)) == pytest.approx((h.T @ x) / h.sum(axis=0)[:, None])
    hop = abs(np.arange(6)[:, None] // 3 - np.arange(6) // 3) + abs(np.arange(6)[:, None] % 3 - np.arange(6) % 3)
    g = np.exp(-0.5 * (hop[d.argmin(axis=1)] / 1.2) ** 2)
    assert by(train.som_epoch(df, book, V.rect_dist("x0", "y0", "x1", "y1"), 1.2)) == pytest.approx((g.T @ x) / g.sum(axis=0)[:, None])
    means = [x[d.argmin(axis=1) == k].mean(axis=0) if (d.argmin(axis=1) == k).any() else w[k] for k in range(6)]
    assert by(train.kmeans_step(df, book)) == pytest.approx(np.array(means))


def test_training_over_neighbours_learns_contexts(spark):
    """Samples of two kinds whose own values are equal, but whose neighbours' are not."""
    rows = [(i, [0.0]) for i in range(10)] + [(10 + i, [10.0 if i % 2 else -10.0]) for i in range(10)]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>")
    near = [(i, 10 + i, 1.0) for i in range(10)] + [(10 + i, 10 + (i + 2) % 10, 1.0) for i in range(10)]
    weights = spark.createDataFrame(near, "src long, dst long, w double")
    book = spark.createDataFrame([(0, [-9.0]), (1, [-0.1]), (2, [0.1]), (3, [9.0])], "neuron_id long, w array<double>")
    for hops in (None, abs(np.arange(4)[:, None] - np.arange(4)).astype(float)):
        got = {r.neuron_id: (r.w[0], r.c[0]) for r in train.wmc_fit(df, weights, book, [1.0, 0.5, 0.1, 0.1, 0.1, 0.1], alpha=0.5, beta=0.0, hops=hops).collect()}
        zeros = sorted(c for w, c in got.values() if abs(w) < 1)
        assert len(got) == 4 and zeros[0] == pytest.approx(-10, abs=0.5) and zeros[-1] == pytest.approx(10, abs=0.5)


def test_fit_draws_from_the_whole_table(spark):
    rows = [(i, [float(i)]) for i in range(500)] + [(900, None), (901, [float("nan")])]
    df = spark.createDataFrame(rows, "sample_id long, x array<double>").repartition(3)
    seen = train.fit(df, lambda x, seed, order: np.array([[x[order].min(), x[order].max(), len(order), len(x)]]), [1, 2], 4000).collect()
    assert len(seen) == 2 and all(r.w[:3] == [0.0, 499.0, 4000.0] and 490 <= r.w[3] <= 500 for r in seen)
    few = train.fit(df, lambda x, seed, order: train.model(x[order], np.zeros((len(order), 2), int), np.array([[0, 2]])), [5], 3).collect()
    assert len(few) == 3 and sorted(map(tuple, (r.joined for r in few))) == [(), (0,), (2,)] and few[0].position == [0, 0]
    assert train.fit(df.limit(0), lambda x, seed, order: x, [1], 10).count() == 0


def test_growing_gas_has_no_limit(spark):
    x = RNG.normal(size=(300, 2))
    w, edges = train.run_gng(x, 1, 3_000, every=20, age_max=10**9, edges=True)
    assert len(w) > 64 and set(edges.ravel().tolist()) == set(range(len(w)))
    assert (train.run_gng(x, 1, 900) == train.run_gng(x, 1, 900)).all()


def test_scaling_without_spread_or_rows(spark):
    df = spark.createDataFrame([(2.0, 1, None), (2.0, 3, None), (None, 5, None)], "a double, b int, c double")
    for chain, want in ((["zscore"], [0.0, 0.0, None]), (["scale01"], [0.0, 0.0, None])):
        s = frame.Scaler(["a", "b", "c"], chain).fit(df)
        out = s.transform(df)
        assert sorted((r.a for r in out.collect()), key=str) == want and all(r.c is None for r in out.collect())
        assert sorted((r.a for r in s.inverse(out).collect()), key=str) == [2.0, 2.0, None]
        empty = frame.Scaler(["a", "b"], chain).fit(df.limit(0))
        assert empty.transform(df.limit(0)).count() == 0 and {r.b for r in empty.transform(df).collect()} == {None}
    one = spark.createDataFrame([(4.0,)], "a double")
    assert frame.Scaler(["a"], ["zscore"]).fit(one).transform(one).first().a == 0.0
    for f in (frame.geo_scale01, frame.geo_zscore):
        assert f(one, ["a"]).first().a == 0.0 and f(one.limit(0), ["a"]).count() == 0 and f(df, ["a", "c"]).select("c").distinct().collect() == [(None,)]


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "m.csv").write_text("\n".join(f"{i},{-i}" for i in range(5000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = files.read_matrix(spark, str(tmp_path / "m.csv"))
        assert got.rdd.getNumPartitions() > 3
        assert sorted((r.i, r.j, r.v) for r in got.collect()) == sorted((i, j, float(v)) for i in range(5000) for j, v in ((0, i), (1, -i)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_components_of_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, k) for k in range(1001, 1400)] + [(5000, 5000)] + [(2001, 2000)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[k] == 1000 for k in range(1000, 1400)) and got[5000] == 5000 and got[2001] == 2000
    assert graph.components(spark.createDataFrame([], "src long, dst long")).count() == 0


# ---------------------------------------------------------------- text formats, clusters in one call, models

def test_graphml_both_ways(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0.5, "a<b"), (2, None, None), (7, 2.0, "&")], "id long, v double, name string")
    edges = spark.createDataFrame([(1, 2, 0.25), (2, 1, 0.5), (7, 7, 1.0)], "src long, dst long, weight double")
    for tag, loops in (("node", True), ("vertex", False)):
        at = str(tmp_path / tag)
        text.write_lines(text.graphml_lines(nodes, edges, tag, loops=loops).coalesce(1), at)
        whole = ElementTree.fromstringlist(r.value for r in spark.read.text(at, wholetext=True).collect())
        ns = "{" + text.GRAPHML + "}"
        assert len(list(whole.iter(ns + tag))) == 3 and len(list(whole.iter(ns + "edge"))) == (3 if loops else 2)
        assert [d.text for d in whole.iter(ns + "data") if d.get("key") == "name"] == ["a<b", "&"]
        n, e = text.read_graphml(spark, at, tag)
        assert sorted((r.id, r.x) for r in n.collect()) == [(1, [None, 0.5]), (2, []), (7, [None, 2.0])]
        assert sorted(map(tuple, e.collect())) == [(1, 2, 1.0), (2, 1, 1.0)] + ([(7, 7, 1.0)] if loops else [])


def test_codebooks_as_xml(spark, tmp_path):
    book = spark.createDataFrame([(0, 0, 0, [1.0, 1e-9]), (1, 0, 1, [-2.5, 3.0])], "neuron_id long, gx int, gy int, w array<double>")
    files.write_grid(book, str(tmp_path / "grid"), hexagonal=True)
    files.write_gas(book, str(tmp_path / "gas"))
    root = ElementTree.fromstring("\n".join(r.value for r in spark.read.text(str(tmp_path / "grid")).collect()))
    assert root.tag == "grid" and root.attrib == {"hex": "true", "toroid": "false"} and root[0].tag == "units"
    assert sorted(map(tuple, text.read_grid(spark, str(tmp_path / "grid")).collect())) == [(0, 0, [1.0, 1e-9]), (0, 1, [-2.5, 3.0])]
    assert sorted(r.w for r in files.read_gas(spark, str(tmp_path / "gas")).collect()) == [[-2.5, 3.0], [1.0, 1e-9]]


def test_matrix_and_regions(spark, tmp_path):
    entries = spark.createDataFrame([(0, 0, 1.5), (0, 2, -2.0), (1, 1, 3.0)], "i long, j long, v double")
    lines = [r.value for r in text.matrix_lines(entries, 3).orderBy("o", "k").collect()]
    assert lines == ["X1,X1,X2", "1.5, 0.0, -2.0", "0.0, 3.0, 0.0"]
    (tmp_path / "r.csv").write_text("n,a,b\n0,5,1\n1,5,2\n2,6,1\n")
    assert sorted(map(tuple, text.read_regions(spark, str(tmp_path / "r.csv"), 2).collect())) == [(0, 1), (1, 2), (2, 1)]


def test_wkt(spark, tmp_path):
    (tmp_path / "g.csv").write_text('id,geom\n# a comment\n1,POINT (1 2)\n2,"POLYGON ((0 0, 1.5 0, 0 1, 0 0), (0.1 0.1, 0.2 0.1, 0.1 0.2, 0.1 0.1))"\n3,\n4,POINT EMPTY\n5,"LINESTRING(-1e3 2,  3 4)"\n')
    got = {int(r.id): r for r in text.read_wkt_csv(spark, str(tmp_path / "g.csv"), 1).collect()}
    assert got[1]["geom"] is not None and got[3].asDict()["geom"] is None
    rows = text.read_wkt_csv(spark, str(tmp_path / "g.csv"), 1).select("id", F.col("geom.kind").alias("kind"), F.transform("geom.rings", lambda r: F.size(r)).alias("n")).collect()
    assert {int(r.id): (r.kind, r.n) for r in rows} == {1: ("POINT", [1]), 2: ("POLYGON", [4, 4]), 3: (None, None), 4: (None, None), 5: ("LINESTRING", [2])}
    again = text.read_wkt_csv(spark, str(tmp_path / "g.csv"), 1).where("geom is not null").select(text.parse_wkt(text.to_wkt(F.col("geom.kind"), F.col("geom.rings"))).alias("b"), "geom")
    assert all(r.b == r.geom for r in again.collect())


def test_clusters_in_one_call(spark):
    x = np.concatenate([RNG.normal(size=(6, 2)) + 20 * k for k in range(3)])
    rows = [(i, v, i // 3, i % 3) for i, v in enumerate(x.tolist())]
    book = spark.createDataFrame(rows, "neuron_id long, w array<double>, gx int, gy int")
    for algo in cluster.ALGORITHMS:
        got = [r.cluster_id for r in cluster.cluster_codebook(book, algo, 3, connected=algo not in ("kmeans",), seed=4).orderBy("neuron_id").collect()]
        assert len(set(got)) == 3 and (got == [0] * 6 + [1] * 6 + [2] * 6 or algo == "kmeans")
    with pytest.raises(ValueError):
        cluster.cluster(x, "other", 2)
    with pytest.raises(ValueError):
        cluster.cluster(x, "skater", 2)


def test_least_size_in_trees():
    x = np.array([[0.0], [1.0], [10.0], [11.0], [30.0]])
    whole = cluster.tree(x, "ward")
    some = cluster.tree(x, "ward", min_size=2)
    assert len(whole) == 4 and [m[:2] for m in some[:2]] == [(0, 1), (2, 3)]
    sizes = {i: 1 for i in range(5)}
    for k, (a, b, _) in enumerate(some):
        assert min(sizes[a], sizes[b]) < 2
        sizes[5 + k] = sizes[a] + sizes[b]
    assert len(some) == 3


def test_modularity_with_restarts_and_number():
    e = {(i, j): 1.0 for g in (range(0, 4), range(4, 8), range(8, 12)) for i in g for j in g if i != j}
    e |= {(a, b): 0.5 for a, b in ((0, 4), (4, 0), (5, 8), (8, 5))}
    a = np.zeros((12, 12))
    for (i, j), w in e.items():
        a[i, j] = w
    one, many = cluster.greedy_modularity(12, e), cluster.greedy_modularity(12, e, restarts=8)
    assert many.tolist() == [0] * 4 + [1] * 4 + [2] * 4 and cluster.modularity(a, many) >= cluster.modularity(a, one)
    assert len(set(cluster.greedy_modularity(12, e, restarts=3, k=2).tolist())) == 2
    assert len(set(cluster.greedy_modularity(12, e, k=5).tolist())) == 5


def test_same_model_and_columns(spark):
    a = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (1, [2.0])], "neuron_id long, w array<double>")
    assert assign.same_model(a, a.select("w", "neuron_id")).first().same and not assign.same_model(a, a.distinct()).first().same
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 1.0), (3.0, 4.0, 9.0, 1.0)], ["a", "b", "c", "one"])
    assert frame.drop_positions(df, {0, 2}).columns == ["b", "one"] and frame.keep_positions(df, [2, 0]).columns == ["a", "c"]
    with pytest.raises(ValueError):
        frame.drop_positions(df, {9})
    s = frame.Scaler(frame.except_intercept(df.columns), ["scale01"]).fit(df).transform(df)
    assert sorted(map(tuple, s.collect())) == [(0.0, 0.0, 0.0, 1.0), (1.0, 1.0, 1.0, 1.0)]
    own = frame.ColumnScaler({"c": ["log"]}, ("a", "b"), "scale01").fit(df).transform(df)
    assert sorted((r.a, r.b, round(r.c, 6)) for r in own.collect()) == [(0.0, 0.0, 1.098612), (1.0, 1.0, 2.197225)]


def test_lag_of_vectors_and_identity(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0]), (3, [5.0, 6.0])], "sample_id long, x array<double>")
    w = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.5), (2, 1, 1.0)], "src long, dst long, w double")
    assert {r.sample_id: r.x for r in weights.lag_vectors(w, df).collect()} == {1: [1.0, 2.0, 4.0, 5.0], 2: [3.0, 4.0, 1.0, 2.0], 3: [5.0, 6.0, 0.0, 0.0]}
    cells = spark.createDataFrame([(k, k // 2, k % 2) for k in range(4)], "id long, i int, j int")
    assert weights.lattice(cells, False, identity=True).count() == 16 and weights.lattice(cells, True, identity=True).count() == 12


def test_watershed(spark):
    labels = spark.createDataFrame([(i, j, i // 2 + 10) for i in range(3) for j in range(3)], "i int, j int, label int")
    book = spark.createDataFrame([(k, k // 2, k % 2) for k in range(6)], "neuron_id long, gx int, gy int")
    assert {r.neuron_id: r.cluster_id for r in cluster.watershed(labels, book).collect()} == {0: 10, 1: 10, 2: 11, 3: 11}


@pytest.mark.parametrize("name", ["inverse_distance", "radius_join", "row_normalize"])
def test_radius_joins_broadcast_no_points(spark, sf, name):
    out = catalog.queries()[name](spark, sf)
    assert out.collect() and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def near_points(spark):
    """Copies of points, of ids and of both, borders of cells, and nulls; with all pairs within 3."""
    x = [(i, i % 9 / 2, i % 5 * 1.5) for i in range(90)] + [(200, -1e-20, 50.0), (201, 3.0, 50.0), (7, 0.5, 0.0), (8, 4.0, 4.5), (8, 4.0, 4.5), (202, 99.0, 99.0), (202, 99.0, 99.0), (202, 99.5, 99.0)]
    pairs = sorted((i, j, d) for i, a, b in x for j, p, q in x if i != j and (d := float(np.sqrt((a - p) ** 2 + (b - q) ** 2))) <= 3.0)
    return spark.createDataFrame([*x, (300, None, 1.0), (301, 1.0, None), (None, 1.0, 1.5)], "id long, px double, py double").repartition(3), pairs


@pytest.mark.parametrize("most", [4, 1024])
def test_radius_groups_hold_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(weights, "MEMBERS", most)
    df, pairs = near_points(spark)
    groups = weights.radius_groups(df, 3.0)
    assert groups.where(F.size("dst") > most).isEmpty() and (200, 201, 3.0) in pairs
    assert sorted(map(tuple, weights.radius_pairs(df, 3.0).collect())) == pairs
    low = min(d for *_, d in pairs if d)
    got = weights.members(weights.inverse_distance(groups, 2.0)).collect()
    assert sorted((r.src, r.dst, round(r.w, 9)) for r in got) == sorted((i, j, round((d or low) ** -2, 9)) for i, j, d in pairs)


def test_rows_within_a_radius_are_normalized(spark, monkeypatch):
    monkeypatch.setattr(weights, "MEMBERS", 4)
    df, pairs = near_points(spark)
    w = [(i, j, d) for i, j, d in pairs if d]
    total = {i: sum(d for k, _, d in w if k == i) for i, *_ in w}
    want = sorted((i, j, round(d / total[i], 9)) for i, j, d in w)
    edges = weights.row_normalize(weights.radius_pairs(df, 3.0).where("dist > 0").withColumnRenamed("dist", "w"))
    for got in (weights.members(weights.row_normalize_radius(df, 3.0)), edges):
        assert sorted((r.src, r.dst, round(r.w, 9)) for r in got.collect()) == want


@pytest.mark.parametrize("kind", ["spread", "clumps", "line", "same"])
def test_nearest_in_the_plane_are_exact(spark, kind):
    n = 700
    x = RNG.random((n, 2)) * [3.0, 1.0]
    if kind == "clumps":
        x = np.round(RNG.normal(size=(n, 2)) * 0.02, 3) + RNG.integers(0, 3, (n, 1)) * 50.0
    if kind == "line":
        x[:, 1] = 0.5
    if kind == "same":
        x[: n // 2] = 0.25
    ids = RNG.permutation(n)
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())] + [(5000, None), (5001, [None, 1.0])], "sample_id long, x array<double>").repartition(3)
    whole = sorted(map(tuple, blocks.knn(df, "x", 4).collect()))
    rows = df.where("sample_id < 5000").select("sample_id", F.col("x")[0].alias("px"), F.col("x")[1].alias("py"))
    cells = sorted(map(tuple, blocks.knn_plane(rows, 4, per_cell=12, block=100).select("src", "dst", "dist", "rank").collect()))
    assert cells == whole and len(whole) == 4 * n
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    for r in range(0, n, 97):
        best = sorted((round(v, 12), int(i)) for v, i in zip(d[r], ids))[:4]
        assert {t[1] for t in whole if t[0] == ids[r]} == {i for _, i in best} or kind == "clumps"


def test_nearest_of_few(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 1.0, 0.0)], "sample_id long, px double, py double")
    assert sorted((r.src, r.dst) for r in blocks.knn_plane(df, 3).collect()) == [(1, 2), (2, 1)]
    assert blocks.knn_plane(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("name", ["som_fit", "ng_fit", "cng_fit", "gng_fit", "growing_som_fit"])
def test_registered_training_fits_the_samples(spark, sf, name):
    x = np.array([r.x for r in models.samples(spark, sf).collect()])
    qe = lambda w: np.sqrt(((x[:, None] - w[None]) ** 2).sum(axis=2)).min(axis=1).mean()
    runs = {}
    for r in catalog.queries()[name](spark, sf).collect():
        runs.setdefault(r.run, []).append(r.w)
    assert len(runs) >= 2
    for w in map(np.array, runs.values()):
        assert np.isfinite(w).all() and (w >= x.min(axis=0) - 1e-6).all() and (w <= x.max(axis=0) + 1e-6).all()
        assert len(w) > 4 and qe(w) < 0.95 * qe(x.mean(axis=0)[None])


@pytest.mark.parametrize(("name", "width"), [("tkm_fit", 1), ("rsom_fit", 1), ("mng_fit", 2), ("msom_fit", 2)])
def test_registered_series_are_learnt_one_by_one(spark, sf, name, width):
    events = spark.read.parquet(f"{sf}/events.parquet").where("value is not null")
    ends = {r.user_id: (r.a, r.b) for r in events.groupBy("user_id").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}
    rows = catalog.queries()[name](spark, sf).collect()
    assert {r.series for r in rows} == set(ends) and len(rows) == 25 * len(ends)
    assert all(len(r.w) == width and ends[r.series][0] - 1e-6 <= r.w[0] <= ends[r.series][1] + 1e-6 for r in rows)
