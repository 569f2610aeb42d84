"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC/1.1 response records in the order of (page_id, digest); records fill
segments of a fixed number of records, so each has a byte range in its segment. An archive is
a table (position, page_id, segment, start, length, record) in the shared folder.
``write_files`` stores it as ``.warc`` files, one a segment, whose ranges are the table's, and
``read_files`` takes the bytes of an index's ranges from such files. A record's id is a UUID made
of its position and digest, so equal pages have records of their own; its date is a parameter,
as pages have none. The tree: a leaf hashes a record's range and digest, a node hashes its
children's hashes in order.

An audit builds both replicas' trees bottom-up (each level is a grouped aggregate over at most
``fanout`` children), compares the roots, and descends only below nodes that differ: each step
joins the children of the differing parents, so equal branches are never looked at again. The
leaves that remain are the damaged, missing or surplus records.

Defined cases: null urls and pages are empty; repeated pages are repeated records; extra columns
are not read; a page of any length is one record; an empty archive has no nodes and differs from
any other; equal replicas give no rows; a missing file has no records and a short one truncated ones.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U
from .bitpack import file_system

SEGMENT = 1024
FANOUT = 64
DATE = "2020-01-01T00:00:00Z"
UUID = 36


def uuid(*parts) -> F.Column:
    """A name-based UUID's form of the MD5 of ``parts``: 36 characters."""
    h = F.md5(F.concat_ws(":", *parts))
    return F.concat_ws("-", h.substr(1, 8), h.substr(9, 4), F.concat(F.lit("3"), h.substr(14, 3)), F.concat(F.lit("8"), h.substr(18, 3)), h.substr(21, 12))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """``pages(page_id, url, html)`` as WARC records up to their id and after it: (page_id, head, tail)."""
    body = F.coalesce("html", F.lit(""))
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), body)
    uri = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", "")
    tail = F.concat(
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), uri, F.lit("\r\nContent-Type: application/http; msgtype=response\r\nWARC-Block-Digest: sha256:"), F.sha2(block, 256),
        F.lit("\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block, F.lit("\r\n\r\n"),
    )
    return pages.select("page_id", F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:").alias("head"), tail.alias("tail"))


def archive(pages: DataFrame, segment: int = SEGMENT, date: str = DATE) -> DataFrame:
    """An archive table of ``pages``: written in record order, each record at its byte range.

    Positions and ranges are found from ids, digests and lengths alone; the records are then
    joined to them by digest, and get their ids.
    """
    rec = records(pages, date).withColumn("digest", F.sha2("tail", 256))
    length = (F.octet_length("head") + UUID + F.octet_length("tail")).cast("long")
    small = U.with_rank(rec.select("page_id", "digest", length.alias("length")), [F.col("page_id").asc_nulls_first(), F.col("digest")], "position")
    before = Window.partitionBy("segment").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    placed = small.withColumn("segment", F.floor(F.col("position") / segment).cast("long"))
    placed = placed.withColumn("start", F.coalesce(F.sum("length").over(before), F.lit(0)))
    # rows of equal digest share their text but for the id
    one = rec.groupBy("digest").agg(F.first("head").alias("head"), F.first("tail").alias("tail"))
    record = F.concat("head", uuid(F.col("position"), F.col("digest")), "tail").cast("binary")
    return U.materialize(placed.join(one, "digest").select("position", "page_id", "segment", "start", "length", record.alias("record")), "warc", "zstd")


def file_of(folder: str, segment: int) -> str:
    return f"{folder}/segment-{segment:08d}.warc"


def write_files(stored: DataFrame, folder: str) -> None:
    """The records of each segment, in order, as a file of ``folder``, which the cluster shares.

    A file is written by one task under a name of its own and then moved to its place, so a task
    that is done twice leaves the same file."""
    fs, name = file_system(folder)
    fs.create_dir(name, recursive=True)

    def write(batches):
        fs, name = file_system(folder)
        held = f = part = None
        rows = 0

        def close():
            if f is not None:
                f.close()
                fs.move(part, file_of(name, held))

        for b in batches:
            for seg, x in zip(b.column("segment").to_pylist(), b.column("record").to_pylist(), strict=True):
                if seg != held:
                    close()
                    held, part = seg, f"{file_of(name, seg)}.{U.attempt()}"
                    f = fs.open_output_stream(part)
                f.write(x)
            rows += b.num_rows
        close()
        yield pa.RecordBatch.from_arrays([pa.array([rows], pa.int64())], names=["rows"])

    order = stored.select("segment", "position", "record").repartition("segment").sortWithinPartitions("segment", "position")
    order.mapInArrow(write, "rows long").agg(F.sum("rows")).collect()


def read_files(index: DataFrame, folder: str) -> DataFrame:
    """``index(position, page_id, segment, start, length)`` with the bytes that the files hold there."""
    keep = ["position", "page_id", "segment", "start", "length"]

    def read(batches):
        fs = name = held = f = None
        for b in batches:
            fs, name = (fs, name) if fs else file_system(folder)
            found, at = [], []
            for i, (seg, start, n) in enumerate(zip(*(b.column(c).to_pylist() for c in ("segment", "start", "length")), strict=True)):
                if seg != held:
                    there = fs.get_file_info(file_of(name, seg)).type == pa.fs.FileType.File
                    held, f = seg, fs.open_input_file(file_of(name, seg)) if there else None
                if f is not None:
                    found.append(f.read_at(n, start))
                    at.append(i)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(at, pa.int64())) for c in keep), pa.array(found, pa.binary())], names=[*keep, "record"])

    page = index.schema["page_id"].dataType.simpleString()
    ordered = index.select(*keep).repartition("segment").sortWithinPartitions("segment", "position")
    return ordered.mapInArrow(read, f"position long, page_id {page}, segment long, start long, length long, record binary")


def leaves(stored: DataFrame) -> DataFrame:
    """Level 0: (node, hash), from what is stored; the recorded range is part of the hash."""
    digest = F.sha2("record", 256)
    return stored.select(F.col("position").alias("node"), F.sha2(F.concat_ws(":", F.col("segment"), F.col("start"), F.col("length"), digest), 256).alias("hash"))


def tree(stored: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the tree, the leaves first; each is written out."""
    levels = [U.materialize(leaves(stored), "merkle")]
    while (top := levels[-1].agg(F.max("node")).first()[0]) is not None and top > 0:
        child = F.sort_array(F.collect_list(F.struct("node", "hash")))
        up = levels[-1].select(F.floor(F.col("node") / fanout).cast("long").alias("parent"), "node", "hash")
        up = up.groupBy("parent").agg(child.alias("c"))
        hashed = F.sha2(F.array_join(F.transform("c", lambda x: F.concat_ws("=", x["node"], x["hash"])), ","), 256)
        levels.append(U.materialize(up.select(F.col("parent").alias("node"), hashed.alias("hash")), "merkle"))
    return levels


def differing(a: list[DataFrame], b: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Leaves whose hashes differ or that one side lacks: (node, hash, other_hash)."""
    depth = max(len(a), len(b))
    wrong = None
    for level in range(depth - 1, -1, -1):
        x, y = (t[level] if level < len(t) else None for t in (a, b))
        if x is None or y is None:  # trees of different heights differ from here on
            wrong = None
            continue
        if wrong is not None:
            parent = F.floor(F.col("node") / fanout).cast("long")
            keep = wrong.select(F.col("node").alias("_p"))
            x, y = (t.join(keep, parent == keep["_p"], "left_semi") for t in (x, y))
        both = x.join(y.withColumnRenamed("hash", "other_hash"), "node", "full")
        wrong = both.where(~F.col("hash").eqNullSafe(F.col("other_hash")))
        if level:
            wrong = U.materialize(wrong, "merkle-diff")
            if wrong.isEmpty():
                return wrong
    return wrong


def audit(primary: DataFrame, replica: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records of ``primary`` that ``replica`` does not hold unchanged, and surplus ones."""
    wrong = differing(tree(primary, fanout), tree(replica, fanout), fanout)
    facts = lambda t, p: t.select(F.col("position").alias("node"), *(F.col(c).alias(p + c) for c in ("page_id", "segment", "start", "length")), F.sha2("record", 256).alias(p + "sha256"), F.octet_length("record").cast("long").alias(p + "stored"))
    out = wrong.select("node").join(facts(primary, ""), "node", "left").join(facts(replica, "replica_"), "node", "left")
    kind = F.when(F.col("replica_sha256").isNull(), "missing").when(F.col("sha256").isNull(), "surplus").when(F.col("stored") != F.col("replica_stored"), "truncated").otherwise("altered")
    both = [F.coalesce(c, "replica_" + c).alias(c) for c in ("page_id", "segment", "start", "length")]
    return out.select(F.col("node").alias("position"), *both, "sha256", "replica_sha256", kind.alias("fault"))


def damaged(stored: DataFrame) -> DataFrame:
    """A replica with faults of three kinds, dealt by the position: an altered byte, a lost last byte,
    a lost record."""
    fault = (F.col("position") * 31 + 5) % 97
    altered = F.concat(F.expr("substring(record, 1, octet_length(record) - 5)"), F.lit(b"!"), F.expr("substring(record, octet_length(record) - 3, 4)"))
    record = F.when(fault == 1, altered).when(fault == 2, F.expr("substring(record, 1, octet_length(record) - 1)")).otherwise(F.col("record"))
    return U.materialize(stored.withColumn("record", record).where(fault != 3), "warc-replica", "zstd")


def op9_warc_fixity(spark, sf_dir: str) -> DataFrame:
    """Archives all pages, makes a replica with known faults, and finds them."""
    primary = archive(U.read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return audit(primary, damaged(primary))
