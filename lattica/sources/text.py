"""Text formats of graphs, codebooks, matrices and geometries, as ordered lines (o, k, value) that are
made where the rows lie; writing them sorts lines by range into one folder of text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reshape import numbered

GRAPHML = "http://graphml.graphdrawing.org/xmlns"


def _fixed(spark: SparkSession, o: int, rows: list[str]) -> DataFrame:
    return spark.createDataFrame([(o, i, r) for i, r in enumerate(rows)], "o int, k long, value string")


def _number(c: Column, digits: int | None) -> Column:
    return c.cast("string") if digits is None else F.format_string(f"%.{digits}f", c.cast("double"))


def escaped(c: Column) -> Column:
    """Text for an XML element or attribute; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def write_lines(lines: DataFrame, path: str) -> None:
    """The lines in their order, over as many files as the session's sort makes."""
    lines.orderBy("o", "k", "value").select("value").write.text(path)


# ---------------------------------------------------------------- GraphML

def graphml_lines(nodes: DataFrame, edges: DataFrame, tag: str = "node", directed: bool = False, loops: bool = True, digits: int | None = None) -> DataFrame:
    """``nodes(id, attributes...)`` and ``edges(src, dst, attributes...)`` as GraphML. ``tag`` names a
    node's element (some readers want ``vertex``); without ``loops`` edges from a node to itself are
    left out. Edges are numbered by (src, dst); null attributes are left out."""
    spark = nodes.sparkSession
    of_node, of_edge = ([(c, "long" if t in ("int", "bigint") else "double" if t in ("double", "float") else "string") for c, t in df.dtypes if c not in ("id", "src", "dst")] for df in (nodes, edges))
    keys = [f'<key id="{c}" for="{kind}" attr.name="{c}" attr.type="{t}"/>' for kind, cs in (("node", of_node), ("edge", of_edge)) for c, t in cs]

    def data(columns):
        cell = lambda c, t: _number(F.col(f"`{c}`"), digits) if t == "double" else escaped(F.col(f"`{c}`"))
        return [F.coalesce(F.concat(F.lit(f'<data key="{c}">'), F.when(F.col(f"`{c}`").isNotNull(), cell(c, t)), F.lit("</data>")), F.lit("")) for c, t in columns]

    head = ['<?xml version="1.0" encoding="UTF-8"?>', f'<graphml xmlns="{GRAPHML}">', *keys, f'<graph id="G" edgedefault="{"directed" if directed else "undirected"}">']
    n = nodes.select(F.lit(1).alias("o"), F.col("id").cast("long").alias("k"), F.concat(F.format_string(f'<{tag} id="%d">', F.col("id")), *data(of_node), F.lit(f"</{tag}>")).alias("value"))
    e = numbered(edges if loops else edges.where("src <> dst"), [F.col("src"), F.col("dst")], "_e")
    e = e.select(F.lit(2).alias("o"), F.col("_e").alias("k"), F.concat(F.format_string('<edge id="%d" source="%d" target="%d">', "_e", "src", "dst"), *data(of_edge), F.lit("</edge>")).alias("value"))
    return _fixed(spark, 0, head).union(n).union(e).union(_fixed(spark, 3, ["</graph>", "</graphml>"]))


def read_graphml(spark: SparkSession, path: str, tag: str = "node") -> tuple[DataFrame, DataFrame]:
    """(nodes(id, x), edges(src, dst, w)) of an undirected GraphML: x has a node's numeric attributes in the
    order of their keys, and each edge counts 1 in both directions, once however often it occurs."""
    cell = "array<struct<_key: string, _VALUE: string>>"
    node = spark.read.format("xml").option("rowTag", tag).schema(f"_id string, data {cell}").load(path)
    x = F.transform(F.array_sort(F.coalesce("data", F.array().cast(cell))), lambda d: d["_VALUE"].try_cast("double"))
    edge = spark.read.format("xml").option("rowTag", "edge").schema("_source string, _target string").load(path)
    a, b = F.col("_source").cast("long"), F.col("_target").cast("long")
    both = edge.select(a.alias("src"), b.alias("dst")).union(edge.select(b, a)).distinct()
    return node.select(F.col("_id").cast("long").alias("id"), x.alias("x")), both.withColumn("w", F.lit(1.0))


# ---------------------------------------------------------------- codebooks

def _unit(digits: int | None, place: bool) -> Column:
    values = F.array_join(F.transform("w", lambda v: F.concat(F.lit("<value>"), _number(v, digits), F.lit("</value>"))), "")
    head = F.format_string('<unit x="%d" y="%d">', "gx", "gy") if place else F.lit("<unit>")
    return F.concat(head, F.lit("<vector>"), values, F.lit("</vector></unit>"))


def grid_lines(codebook: DataFrame, hexagonal: bool, toroid: bool, digits: int | None = None) -> DataFrame:
    """``codebook(neuron_id, gx, gy, w)`` as the XML of a grid; ``files.read_grid`` reads it."""
    spark = codebook.sparkSession
    head = f'<grid hex="{str(hexagonal).lower()}" toroid="{str(toroid).lower()}">'
    units = codebook.select(F.lit(1).alias("o"), F.col("neuron_id").cast("long").alias("k"), _unit(digits, True).alias("value"))
    return _fixed(spark, 0, ['<?xml version="1.0" encoding="UTF-8"?>', head, "<units>"]).union(units).union(_fixed(spark, 2, ["</units>", "</grid>"]))


def gas_lines(codebook: DataFrame, digits: int | None = None) -> DataFrame:
    """``codebook(neuron_id, w)`` as the XML of a gas; ``files.read_gas`` reads it."""
    spark = codebook.sparkSession
    units = codebook.select(F.lit(1).alias("o"), F.col("neuron_id").cast("long").alias("k"), _unit(digits, False).alias("value"))
    return _fixed(spark, 0, ['<?xml version="1.0" encoding="UTF-8"?>', "<gas>", "<units>"]).union(units).union(_fixed(spark, 2, ["</units>", "</gas>"]))


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """(gx, gy, w) of grid/units/unit/vector/value."""
    raw = spark.read.format("xml").option("rowTag", "unit").schema("_x int, _y int, vector struct<value: array<double>>").load(path)
    return raw.select(F.col("_x").alias("gx"), F.col("_y").alias("gy"), F.col("vector.value").alias("w"))


# ---------------------------------------------------------------- matrices and results

def matrix_lines(entries: DataFrame, columns: int, digits: int | None = None) -> DataFrame:
    """``entries(i, j, v)`` as a matrix with a header X1,X1,X2,... (the first name stands twice, as readers
    of such files expect); absent entries are 0. A row of the matrix is one group."""
    spark = entries.sparkSession
    head = ",".join(["X1", *(f"X{i}" for i in range(1, columns))])
    cells = F.map_from_entries(F.collect_list(F.struct("j", "v")))
    rows = entries.groupBy("i").agg(cells.alias("m"))
    value = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(columns - 1).cast("long")), lambda j: _number(F.coalesce(F.element_at("m", j), F.lit(0.0)), digits)), ", ")
    return _fixed(spark, 0, [head]).union(rows.select(F.lit(1).alias("o"), F.col("i").cast("long").alias("k"), value.alias("value")))


def read_regions(spark: SparkSession, path: str, column: int) -> DataFrame:
    """(num, region) of a result table: the first column numbers samples from 0, ``column`` has the region."""
    raw = spark.read.csv(path, header=True)
    return raw.select(F.col(f"`{raw.columns[0]}`").cast("long").alias("num"), F.col(f"`{raw.columns[column]}`").cast("int").alias("region"))


# ---------------------------------------------------------------- WKT

def parse_wkt(c: Column) -> Column:
    """struct<kind, rings> of well-known text: every innermost pair of brackets is a ring (or part) of points;
    null for null or for text without such a pair, as in EMPTY."""
    point = lambda p: F.filter(F.split(F.trim(p), r"\s+"), lambda v: v != "")
    rings = F.transform(F.regexp_extract_all(c, F.lit(r"\(([^()]+)\)"), 1), lambda r: F.transform(F.split(r, ","), lambda p: F.struct(point(p)[0].cast("double").alias("x"), point(p)[1].cast("double").alias("y"))))
    kind = F.upper(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    return F.when(F.size(rings) > 0, F.struct(kind.alias("kind"), rings.alias("rings")))


def to_wkt(kind: Column, rings: Column, digits: int | None = None) -> Column:
    """Text of a POINT, LINESTRING or POLYGON."""
    points = F.transform(rings, lambda r: F.array_join(F.transform(r, lambda p: F.concat(_number(p["x"], digits), F.lit(" "), _number(p["y"], digits))), ", "))
    one, many = F.concat(F.lit(" ("), points[0], F.lit(")")), F.concat(F.lit(" (("), F.array_join(points, "), ("), F.lit("))"))
    return F.concat(kind, F.when(kind == "POLYGON", many).otherwise(one))


def read_wkt_csv(spark: SparkSession, path: str, column: int, sep: str = ",") -> DataFrame:
    """The rows of a CSV with a header and quoted cells, and ``geom`` parsed from the text of one column; lines with # are comments."""
    raw = spark.read.csv(path, header=True, comment="#", sep=sep)
    return raw.withColumn("geom", parse_wkt(F.col(f"`{raw.columns[column]}`")))
