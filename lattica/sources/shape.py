"""Shapefiles, GML graphs and the text formats of SOM toolboxes.

A shapefile is at most 2 GB by its format, so one file is one task's work and many files are read
in parallel, through Spark's own reader. Writers of single files take a bounded number of rows.
"""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shape types of the format (fixed values).
POINT, POLYGON, MULTIPOINT = 1, 5, 8
RING = "array<array<struct<x: double, y: double>>>"
SCHEMA = f"file string, id long, kind string, rings {RING}, attrs map<string, double>"


def parse_shp(data: bytes) -> list[tuple[str, list]]:
    """(kind, rings) of each record; a point is a ring of one position; null shapes have no rings."""
    out, at = [], 100
    while at + 8 <= len(data):
        words = struct.unpack_from(">i", data, at + 4)[0]
        kind = struct.unpack_from("<i", data, at + 8)[0]
        body = at + 12
        if kind == POINT:
            out.append(("point", [[struct.unpack_from("<2d", data, body)]]))
        elif kind == MULTIPOINT:
            n = struct.unpack_from("<i", data, body + 32)[0]
            out.append(("multipoint", [[struct.unpack_from("<2d", data, body + 36 + 16 * i)] for i in range(n)]))
        elif kind == POLYGON:
            parts, n = struct.unpack_from("<2i", data, body + 32)
            first = [*struct.unpack_from(f"<{parts}i", data, body + 40), n]
            base = body + 40 + 4 * parts
            out.append(("polygon", [[struct.unpack_from("<2d", data, base + 16 * i) for i in range(a, b)] for a, b in zip(first, first[1:], strict=False)]))
        elif kind == 0:
            out.append(("null", []))
        else:
            raise ValueError(f"shape type {kind} is not supported")
        at += 8 + 2 * words
    return out


def parse_dbf(data: bytes) -> list[dict[str, float | None]]:
    """Numeric fields of each row; other fields are left out and blanks are null."""
    rows, head, width = struct.unpack_from("<IHH", data, 4)
    fields, at, off = [], 32, 1
    while data[at] != 0x0D:
        name, kind, size = data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]
        if kind in "NF":
            fields.append((name, off, size))
        off += size
        at += 32
    out = []
    for r in range(rows):
        base, row = head + r * width, {}
        for name, o, size in fields:
            cell = data[base + o : base + o + size].strip(b" \0*")
            row[name] = float(cell) if cell else None
        out.append(row)
    return out


def read_shapefiles(spark: SparkSession, path: str) -> DataFrame:
    """All .shp and .dbf below ``path``: (file, id, kind, rings, attrs). Record i of a shape file belongs to row i of its table."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    stem = F.regexp_extract("path", r"([^/]*)\.(?:shp|dbf)$", 1)
    part = lambda e, n: raw.where(F.col("path").endswith(e)).select(stem.alias("file"), F.col("content").alias(n))
    files = part(".shp", "shp").join(part(".dbf", "dbf"), "file", "left")

    def run(batches):
        for b in batches:
            for file, shp, dbf in zip(b.column("file").to_pylist(), b.column("shp").to_pylist(), b.column("dbf").to_pylist(), strict=True):
                shapes = parse_shp(shp)
                rows = parse_dbf(dbf) if dbf else [{} for _ in shapes]
                for lo in range(0, len(shapes), 4096):
                    some = range(lo, min(lo + 4096, len(shapes)))
                    yield pa.RecordBatch.from_pylist([{"file": file, "id": i, "kind": shapes[i][0], "rings": [[{"x": x, "y": y} for x, y in r] for r in shapes[i][1]], "attrs": list(rows[i].items())} for i in some], schema=target)

    point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
    target = pa.schema([("file", pa.string()), ("id", pa.int64()), ("kind", pa.string()), ("rings", pa.list_(pa.list_(point))), ("attrs", pa.map_(pa.string(), pa.float64()))])
    return files.mapInArrow(run, SCHEMA)


def shp_bytes(shapes: list[tuple[str, list]]) -> tuple[bytes, bytes]:
    """The .shp and .shx of shapes that all are points or all are polygons."""
    kinds = {k for k, _ in shapes} or {"point"}
    if len(kinds) > 1 or not kinds <= {"point", "polygon"}:
        raise ValueError("one file holds points only or polygons only")
    kind = POINT if kinds == {"point"} else POLYGON
    box = lambda pts: (min(p[0] for p in pts), min(p[1] for p in pts), max(p[0] for p in pts), max(p[1] for p in pts)) if pts else (0.0,) * 4
    body, index, at = [], [], 50
    for i, (_, rings) in enumerate(shapes):
        flat = [p for r in rings for p in r]
        if kind == POINT:
            rec = struct.pack("<i2d", kind, *flat[0])
        else:
            starts = [sum(len(r) for r in rings[:j]) for j in range(len(rings))]
            rec = struct.pack("<i4d2i", kind, *box(flat), len(rings), len(flat)) + struct.pack(f"<{len(rings)}i", *starts) + b"".join(struct.pack("<2d", *p) for p in flat)
        body.append(struct.pack(">2i", i + 1, len(rec) // 2) + rec)
        index.append(struct.pack(">2i", at, len(rec) // 2))
        at += 4 + len(rec) // 2
    bounds = struct.pack("<8d", *box([p for _, rings in shapes for r in rings for p in r]), 0, 0, 0, 0)
    head = lambda words: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, words) + struct.pack("<2i", 1000, kind) + bounds
    return head(at) + b"".join(body), head(50 + 4 * len(index)) + b"".join(index)


def dbf_bytes(columns: list[str], rows: list[list[float | None]]) -> bytes:
    """A table of numbers; names are cut to 8 characters and must stay distinct."""
    short = [c[:8] for c in columns]
    if len(set(short)) < len(short):
        raise ValueError("names are equal in their first 8 characters")
    size = 24
    fields = b"".join(struct.pack("<11sc4xBB14x", c.encode("latin-1", "replace"), b"F", size, 15) for c in short)
    head = struct.pack("<4BIHH20x", 3, 100, 1, 1, len(rows), 32 + len(fields) + 1, 1 + size * len(columns))
    cell = lambda v: (" " * size if v is None or v != v else repr(float(v))[:size].rjust(size)).encode()
    return head + fields + b"\r" + b"".join(b" " + b"".join(cell(v) for v in r) for r in rows) + b"\x1a"


def _put(spark: SparkSession, path: str, data: bytes) -> None:
    """Writes one file through Hadoop, so that any store that Spark writes to will do."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def write_shapefile(df: DataFrame, path: str, columns: list[str], most_rows: int = 200_000) -> None:
    """``df(id, kind, rings, columns...)`` in the order of id as path.shp, .shx and .dbf. One file is
    one writer's work: more than ``most_rows`` rows raise; write several files then."""
    rows = df.select("id", "kind", "rings", *columns).orderBy("id").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"one shapefile takes at most {most_rows} rows")
    shp, shx = shp_bytes([(r["kind"], [[(p["x"], p["y"]) for p in ring] for ring in r["rings"]]) for r in rows])
    parts = {"shp": shp, "shx": shx, "dbf": dbf_bytes(columns, [[r[c] for c in columns] for r in rows])}
    for end, data in parts.items():
        _put(df.sparkSession, f"{path}.{end}", data)


# ---------------------------------------------------------------- text formats

def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """An undirected graph of ``nodes(id)`` and ``edges(a, b)`` as ordered GML lines (o, k, value)."""
    spark = nodes.sparkSession
    end = lambda o, rows: spark.createDataFrame([(o, i, r) for i, r in enumerate(rows)], "o int, k long, value string")
    n = nodes.select(F.lit(1).alias("o"), F.col("id").alias("k"), F.format_string("node [ id %d ]", "id").alias("value"))
    e = edges.select(F.lit(2).alias("o"), F.col("a").alias("k"), F.format_string("edge [ source %d target %d ]", "a", "b").alias("value"))
    return end(0, ["graph [", "directed 0"]).union(n).union(e).union(end(3, ["]"])).orderBy("o", "k", "value")


def somlib_lines(codebook: DataFrame) -> DataFrame:
    """``codebook(neuron_id, gx, gy, w)`` as a SOMLib weight file: lines (k, value), units by row."""
    head = codebook.agg((F.max("gx") + 1).alias("nx"), (F.max("gy") + 1).alias("ny"), F.max(F.size("w")).alias("dim"))
    rows = head.select(F.explode(F.array(*(F.struct(F.lit(i - 4).cast("long").alias("k"), v.alias("value")) for i, v in enumerate((F.lit("$TYPE som"), F.format_string("$XDIM %d", "nx"), F.format_string("$YDIM %d", "ny"), F.format_string("$VEC_DIM %d", "dim")))))).alias("s")).select("s.*")
    place = F.col("gy").cast("long") * F.col("nx") + F.col("gx")
    unit = codebook.join(F.broadcast(head)).select(place.alias("k"), F.concat_ws(" ", F.transform("w", lambda v: v.cast("string")), F.format_string("SOM_MAP_(%d/%d/0)", "gx", "gy")).alias("value"))
    return rows.union(unit).orderBy("k")


def somlib_vectors(samples: DataFrame) -> DataFrame:
    """``samples(sample_id, x)`` as a SOMLib vector file: lines (k, value)."""
    head = samples.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("dim"))
    rows = head.select(F.explode(F.array(*(F.struct(F.lit(i).alias("o"), F.lit(i).cast("long").alias("k"), v.alias("value")) for i, v in enumerate((F.lit("$TYPE vec"), F.format_string("$XDIM %d", "n"), F.lit("$YDIM 1"), F.format_string("$VEC_DIM %d", "dim")))))).alias("s")).select("s.*")
    body = samples.select(F.lit(9).alias("o"), F.col("sample_id").cast("long").alias("k"), F.concat_ws(" ", F.transform("x", lambda v: v.cast("string")), F.col("sample_id").cast("string")).alias("value"))
    return rows.union(body).orderBy("o", "k").select("k", "value")


def somlib_units(best: DataFrame, codebook: DataFrame) -> DataFrame:
    """``best(sample_id, neuron_id)`` as the units of a SOMLib unit file, one row a unit:
    (gx, gy, hits, samples). A unit's sample list is text of its own size."""
    hits = best.groupBy("neuron_id").agg(F.count("*").alias("hits"), F.concat_ws(" ", F.array_sort(F.collect_list("sample_id")).cast("array<string>")).alias("samples"))
    return codebook.select("neuron_id", "gx", "gy").join(hits, "neuron_id", "left").select("gx", "gy", F.coalesce("hits", F.lit(0)).alias("hits"), F.coalesce("samples", F.lit("")).alias("samples"))


def read_somlib_weights(spark: SparkSession, path: str) -> DataFrame:
    """(gx, gy, w) of a weight file; positions come from the units' names."""
    t = spark.read.text(path).where(~F.col("value").startswith("$")).select(F.split(F.trim("value"), r"\s+").alias("c"))
    name = F.element_at("c", -1)
    at = lambda i: F.regexp_extract(name, r"\((\d+)/(\d+)/", i).cast("int")
    return t.select(at(1).alias("gx"), at(2).alias("gy"), F.expr("transform(slice(c, 1, size(c) - 1), v -> cast(v AS double))").alias("w"))
