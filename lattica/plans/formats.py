"""Queries over text formats, models and columns, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assign, cluster, frame, region, weights
from ..sources import shape, text
from . import tables as T
from .models import samples
from .oracle import fifth, r6, rounded
from .regions import TWO, grid_cells, hebbian, shared

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return keep


def lines(rows: list[str]) -> str:
    return "SELECT unnest([" + ", ".join("'" + r + "'" for r in rows) + "]) AS value"


HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_KEYS = [f'<key id="{k}" for="{e}" attr.name="{k}" attr.type="{t}"/>' for k, e, t in (("n0", "node", "double"), ("n1", "node", "double"), ("cnt", "edge", "long"), ("fDist", "edge", "double"), ("gDist", "edge", "double"))]


@query("graphml_lines", f"""WITH {TWO} {lines([HEAD, f'<graphml xmlns="{text.GRAPHML}">', *_KEYS, '<graph id="G" edgedefault="undirected">', '</graph>', '</graphml>'])}
UNION ALL SELECT printf('<vertex id="%d"><data key="n0">%.4f</data><data key="n1">%.4f</data></vertex>', neuron_id, w[1], w[2]) FROM cb
UNION ALL SELECT printf('<edge id="%d" source="%d" target="%d"><data key="cnt">%d</data><data key="fDist">%.4f</data><data key="gDist">%.4f</data></edge>', row_number() OVER (ORDER BY a, b) - 1, a, b, cnt, f_dist, g_dist) FROM he""")
def graphml(spark, d):
    """The Hebbian graph of a codebook, its neurons with two components and its edges with counts and distances."""
    nodes = T.codebook(spark, d).select(F.col("neuron_id").alias("id"), F.col("w")[0].alias("n0"), F.col("w")[1].alias("n1"))
    e = hebbian(spark, d).select(F.col("a").alias("src"), F.col("b").alias("dst"), "cnt", F.col("f_dist").alias("fDist"), F.col("g_dist").alias("gDist"))
    return text.graphml_lines(nodes, e, "vertex", loops=False, digits=4).select("value")


_VALUES = "array_to_string(list_transform(w, lambda v: printf('<value>%.4f</value>', v)), '')"


@query("grid_lines", f"""WITH {T.CB} {lines([HEAD, '<grid hex="false" toroid="true">', '<units>', '</units>', '</grid>'])}
UNION ALL SELECT printf('<unit x="%d" y="%d"><vector>', gx, gy) || {_VALUES} || '</vector></unit>' FROM cb""")
def grid_lines(spark, d):
    return text.grid_lines(T.codebook(spark, d), False, True, digits=4).select("value")


@query("gas_lines", f"WITH {T.CB} {lines([HEAD, '<gas>', '<units>', '</units>', '</gas>'])} UNION ALL SELECT '<unit><vector>' || {_VALUES} || '</vector></unit>' FROM cb")
def gas_lines(spark, d):
    return text.gas_lines(T.codebook(spark, d), digits=4).select("value")


@query("matrix_lines", "WITH c AS (SELECT n_nationkey AS i, n_regionkey AS j FROM nation) SELECT 'X1,X1,X2,X3,X4' AS value UNION ALL SELECT array_to_string(list_transform(range(5), lambda k: printf('%.1f', CASE WHEN k = j THEN i + 0.5 ELSE 0 END::DOUBLE)), ', ') FROM c")
def matrix_lines(spark, d):
    """Nations by regions, a number where they meet."""
    n = T.read(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_regionkey").cast("long").alias("j"), (F.col("n_nationkey") + 0.5).cast("double").alias("v"))
    return text.matrix_lines(n, 5, digits=1).select("value")


@query("wkt_roundtrip", f"WITH {T.CELLS} SELECT id, 'POLYGON' AS kind, 5::BIGINT AS corners, i + 0.5::DOUBLE AS x, j + 0.5::DOUBLE AS y FROM cells")
def wkt_roundtrip(spark, d):
    """Cells as text and back: the means of their corners."""
    cells = region.square_cells(grid_cells(spark))
    back = cells.select("id", text.parse_wkt(text.to_wkt(F.lit("POLYGON"), F.array("ring"))).alias("g")).select("id", "g.kind", F.col("g.rings")[0].alias("r"))
    mid = lambda c: ((F.array_min(F.transform("r", lambda p: p[c])) + F.array_max(F.transform("r", lambda p: p[c]))) / 2)
    return back.select("id", "kind", F.size("r").cast("long").alias("corners"), mid("x").alias("x"), mid("y").alias("y"))


@query("results_shapefile", f"WITH {T.ASSIGN} SELECT sample_id AS id, neuron_id::DOUBLE AS neuron, round(cb.w[1], 6) AS nvalue, (neuron_id * 1000)::DOUBLE AS selcolor FROM r JOIN cb USING (neuron_id) WHERE rank = 1")
def results_shapefile(spark, d):
    """Samples as points with their neuron, its value and its colour, in a shape file and back."""
    at = shared(spark, "results")
    best = assign.bmu_euclid(T.vec(spark, d).select("sample_id", "x", "g"), T.codebook(spark, d).select("neuron_id", "w"))
    value = T.codebook(spark, d).select("neuron_id", F.col("w")[0].alias("nvalue"), (F.col("neuron_id") * 1000).alias("selcolor"))
    rows = best.join(assign.small(value), "neuron_id")
    point = F.array(F.array(F.struct(F.col("g")[0].alias("x"), F.col("g")[1].alias("y"))))
    shape.write_shapefile(rows.select(F.col("sample_id").alias("id"), F.lit("point").alias("kind"), point.alias("rings"), F.col("neuron_id").cast("double").alias("neuron"), "nvalue", F.col("selcolor").cast("double").alias("selcolor")), f"{at}/results", ["neuron", "nvalue", "selcolor"])
    got = shape.read_shapefiles(spark, at)
    return got.select("id", F.col("attrs")["neuron"].alias("neuron"), r6(F.col("attrs")["nvalue"]).alias("nvalue"), F.col("attrs")["selcolor"].alias("selcolor"))


@query("lag_vectors", f"WITH {T.KNN}, l AS (SELECT src, pos, sum(0.2 * v) AS v FROM (SELECT src, unnest(x) AS v, generate_subscripts(x, 1) AS pos FROM knn JOIN vec ON sample_id = dst) GROUP BY ALL) SELECT src AS sample_id, pos, round(vec.x[pos], 6) AS own, round(v, 6) AS lag FROM l JOIN vec ON sample_id = src")
def lag_vectors(spark, d):
    out = weights.lag_vectors(fifth(spark, d), samples(spark, d))
    half = F.size("x") / 2
    own, lag = F.slice("x", 1, half.cast("int")), F.slice("x", half.cast("int") + 1, half.cast("int"))
    rows = out.select("sample_id", F.posexplode(F.arrays_zip(own.alias("own"), lag.alias("lag"))).alias("pos", "v"))
    return rows.select("sample_id", (F.col("pos") + 1).cast("long").alias("pos"), r6("v.own").alias("own"), r6("v.lag").alias("lag"))


@query("lattice_identity", f"WITH {T.CELLS} SELECT a.id AS src, b.id AS dst FROM cells a JOIN cells b ON greatest(abs(a.i - b.i), abs(a.j - b.j)) <= 1")
def lattice_identity(spark, d):
    return weights.lattice(grid_cells(spark), False, identity=True)


@query("same_model", f"WITH {T.CB} SELECT count(*) = 0 AS same FROM (SELECT neuron_id, w FROM cb EXCEPT ALL SELECT neuron_id, w FROM cb WHERE neuron_id <> 3)")
def same_model(spark, d):
    book = T.codebook(spark, d).select("neuron_id", "w")
    return assign.same_model(book, book.where("neuron_id <> 3"))


@query("watershed", f"WITH {T.CB} SELECT neuron_id, ((2 * gx * 2 * gy) % 7)::BIGINT AS cluster_id FROM cb WHERE gx < 4")
def watershed(spark, d):
    """Labels of an image of 8 x 9 cells on a map of 5 x 5 units."""
    image = T.cells(spark, 8, 9).select(F.col("i").alias("i"), F.col("j").alias("j"), (F.col("i") * F.col("j") % 7).alias("label"))
    return cluster.watershed(image, T.codebook(spark, d))


@query("keep_positions", "SELECT c_custkey, c_acctbal FROM customer")
def keep_positions(spark, d):
    c = T.read(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    return frame.keep_positions(c, [2, 0])


@query("scaled_by_column", "WITH s AS (SELECT min(p_size) AS a, max(p_size) AS b, avg(ln(p_retailprice)) AS m, stddev_samp(ln(p_retailprice)) AS sd FROM part) SELECT p_partkey, round((p_size - a) / (b - a)::DOUBLE, 6) AS p_size, round((ln(p_retailprice) - m) / sd, 6) AS p_retailprice FROM part, s")
def scaled_by_column(spark, d):
    p = T.read(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return rounded(frame.ColumnScaler({"p_size": ["scale01"], "p_retailprice": ["log", "zscore"]}).fit(p).transform(p), "p_size", "p_retailprice")


@query("bmu_ignoring", f"WITH {T.CB} SELECT sample_id, min({{'d': list_distance(x, w), 'n': neuron_id}}).n AS neuron_id FROM vec, cb WHERE neuron_id NOT IN (3, 7, 11) GROUP BY sample_id")
def bmu_ignoring(spark, d):
    return assign.bmu_euclid(samples(spark, d), T.codebook(spark, d).select("neuron_id", "w"), ignore={3, 7, 11}).select("sample_id", "neuron_id")
