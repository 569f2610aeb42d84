"""Readers and writers of the interchange formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import text


def read_numeric_csv(spark: SparkSession, path: str, sep: str = ",", ignore: tuple[int, ...] = ()) -> DataFrame:
    """Columns of numbers; empty cells are null, ``#`` starts comments, and a column with any other
    cell is dropped. One scan decides, on all rows."""
    raw = spark.read.csv(path, header=True, comment="#", sep=sep)
    names = [c for i, c in enumerate(raw.columns) if i not in ignore]
    bad = raw.agg(*(F.count_if(F.expr(f"try_cast(`{c}` AS double)").isNull() & F.col(f"`{c}`").isNotNull() & (F.trim(F.col(f"`{c}`")) != "")).alias(c) for c in names)).first()
    return raw.select(*(F.expr(f"try_cast(`{c}` AS double)").alias(c) for c in names if not bad[c]))


def read_mixed_csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Numbers where a whole column is numeric, text elsewhere; ragged rows fail."""
    raw = spark.read.csv(path, header=True, sep=sep, mode="FAILFAST")
    good = read_numeric_csv(spark, path, sep).columns
    return raw.select(*((F.expr(f"try_cast(`{c}` AS double)").alias(c) if c in good else F.col(f"`{c}`")) for c in raw.columns))


def read_points_csv(spark: SparkSession, path: str, x: str, y: str, z: str | None = None) -> DataFrame:
    df = read_numeric_csv(spark, path)
    return df.withColumn("geom", F.struct(F.col(x).alias("x"), F.col(y).alias("y"), *([F.col(z).alias("z")] if z else [])))


def lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(name, value): the lines of text files, numbered densely in the order of the files. Splits are counted
    first, and a line's number is its split's offset plus its place in the split."""
    raw = spark.read.text(path).withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = raw.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_s"))
    place = F.col("_id").bitwiseAND((1 << 33) - 1)
    return raw.join(F.broadcast(starts), part == F.col("_p")).select((F.col("_s") + place).alias(name), "value")


def read_matrix(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A headerless numeric matrix as (i, j, v); rows are numbered 0.. in file order."""
    rows = lines(spark, path, "i")
    return rows.select("i", F.posexplode(F.split("value", sep)).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def read_square_distances(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """(src, dst, w); an empty cell is no entry."""
    rows = lines(spark, path, "src")
    cells = rows.select("src", F.posexplode(F.split("value", sep)).alias("dst", "w"))
    return cells.where(F.trim("w") != "").select("src", F.col("dst").cast("long").alias("dst"), F.col("w").cast("double").alias("w"))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """A header, then id1,id2 or id1,id2,dist."""
    df = spark.read.csv(path, header=True)
    names = [F.col(f"`{df.columns[0]}`").cast("long").alias("src"), F.col(f"`{df.columns[1]}`").cast("long").alias("dst")]
    return df.select(*names, *([F.col(f"`{df.columns[2]}`").cast("double").alias("w")] if len(df.columns) > 2 else []))


def write_edges(edges: DataFrame, path: str) -> None:
    names = {"src": "id1", "dst": "id2", "w": "dist"}
    edges.select(*(F.col(c).alias(names[c]) for c in ("src", "dst", "w") if c in edges.columns)).write.csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles whose values are all whole are written as whole numbers."""
    doubles = [c for c, t in df.dtypes if t == "double"]
    whole = df.agg(*(F.coalesce(F.bool_and(F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) == F.floor(c))), F.lit(False)).alias(c) for c in doubles)).first() if doubles else {}
    df.select(*(F.col(c).cast("long").alias(c) if c in doubles and whole[c] else F.col(c) for c in df.columns)).write.csv(path, header=True)


def read_gas(spark: SparkSession, path: str) -> DataFrame:
    """(w) of gas/units/unit/vector/value."""
    schema = "vector struct<value: array<double>>"
    return spark.read.format("xml").option("rowTag", "unit").schema(schema).load(path).select(F.col("vector.value").alias("w"))


def write_gas(codebook: DataFrame, path: str) -> None:
    text.write_lines(text.gas_lines(codebook).coalesce(1), path)


def write_grid(codebook: DataFrame, path: str, hexagonal: bool = False, toroid: bool = False) -> None:
    """Units with their positions as attributes."""
    text.write_lines(text.grid_lines(codebook, hexagonal, toroid).coalesce(1), path)


def read_fcps(spark: SparkSession, lrn: str, cls: str) -> DataFrame:
    """Tab-separated vectors and classes joined on their id: (id, x, class)."""
    def rows(path):
        return spark.read.text(path).where(~F.col("value").startswith("%")).select(F.split("value", "\t").alias("c"))

    v = rows(lrn).select(F.col("c")[0].cast("long").alias("id"), F.transform(F.expr("slice(c, 2, size(c))"), lambda s: s.cast("double")).alias("x"))
    return v.join(rows(cls).select(F.col("c")[0].cast("long").alias("id"), F.col("c")[1].cast("int").alias("class")), "id")


def graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GraphML as ordered lines: ``nodes(id, ...attributes)``, ``edges(src, dst, w)``, directed."""
    return text.graphml_lines(nodes, edges.withColumnRenamed("w", "value"), directed=True).orderBy("o", "k", "value")


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    graphml_lines(nodes, edges).select("value").write.text(path)
