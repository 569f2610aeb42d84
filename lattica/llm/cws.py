"""Document fingerprints by consistent weighted sampling, in SQL functions only.

A term is a pair of adjacent words (parted by ASCII white space; the last word pairs with
nothing), its weight the number of times it occurs. A signature has ``SAMPLES`` independent
consistent samples of the weighted terms, and two signatures agree in a sample with a
probability that is the generalised Jaccard similarity of the texts: sum of least weights over
sum of greatest.

``sign`` draws all samples of a text together. Weights are whole, so a term of weight w is w
units, told by term and number. A unit throws darts 0, 1, ...; dart j hits a sample by its
hash, at rank j plus a uniform fraction, and a sample keeps the dart of the least rank of all
units. Every unit's ranks in a sample follow one law, independent of other units, so each of
the units of two texts' union is as likely as any other to be the least, and it is common to
both with exactly the probability above. A text of W units throws darts only up to a rank of
``LEAST`` to twice as many for each sample (a power of two, so that texts of like length stop
alike), which costs O(W + SAMPLES) and not O(W * SAMPLES). A sample that no dart hits stays
empty (less than 2 % of them); likeness counts samples that either text uses.

``sign_by_gamma`` is Ioffe's (2010) form for weights of any kind: a term draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) anew for every sample; with t = floor(ln w / r + b), the term of the least
ln c - r (t - b + 1) is kept together with t. Its law is the same; it needs W * SAMPLES draws.

``fingerprint`` is 6 hexadecimal digits for each used sample: its number and 16 bits of the dart.

Defined cases: null and empty texts, and texts of white space only, hold the one empty term
and are alike; equal texts have equal fingerprints; a text of one word has one term; repeated
rows are each their own row; a null doc_id comes last in descending order; an empty table
gives an empty result; extra columns are not read. A text of any length is one row of one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import _util as U

NULL_ID = -(1 << 63)
SAMPLES = 128  # a power of two, at most 128: 7 bits of the sort key
LEAST = 4  # darts a sample, at least; twice as many at most


def words_sql(text: str) -> str:
    return f"split(trim(BOTH ' \\t\\n\\r\\u000B\\f' FROM coalesce({text}, '')), '[\\\\x20\\\\x09-\\\\x0D]+')"


TERMS = "sort_array(zip_with(_w, slice(_w, 2, size(_w)), (a, b) -> xxhash64(a, coalesce(b, ''))))"
#: Where each run of equal terms begins, and after the last the number of terms.
RUNS = "concat(filter(sequence(0, size(_s) - 1), i -> i = 0 or _s[i] <> _s[i - 1]), array(size(_s)))"
#: Dart j of unit k of a term: x & 127 is the sample, then come j and the other bits of x.
KEY = f"((x & {SAMPLES - 1}L) << 56) | (shiftleft(cast({{j}} as bigint), 45)) | shiftrightunsigned(x, 19)"


def sign(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with the signature of ``text``: array<int> of sample * 65536 + 16 bits, in order of samples."""
    kept = docs.columns
    d = docs.withColumn("_w", F.expr(words_sql(text)))
    d = d.withColumn("_s", F.expr(TERMS)).withColumn("_u", F.expr(RUNS))
    # darts of each unit: a whole power of two where units are few, else those of dart 0 below a power of one half
    d = d.withColumn("_m", F.expr(f"cast(pow(2D, ceil(log2({LEAST * SAMPLES}D / size(_s)))) as double)"))
    # units of a term; the first is the term itself, as most terms occur once
    more = "transform(sequence(0, e - i - 1), k -> if(k = 0, _s[i], xxhash64(_s[i], k)))"
    units = f"flatten(zip_with(slice(_u, 1, size(_u) - 1), slice(_u, 2, size(_u)), (i, e) -> if(e = i + 1, array(_s[i]), {more})))"
    d = d.withColumn("_n", F.expr(units))
    few = f"flatten(transform(_n, h -> transform(transform(sequence(0, cast(_m as int) - 1), j -> xxhash64(h, j, 1)), (x, j) -> {KEY.format(j='j')})))"
    many = f"transform(filter(transform(_n, h -> xxhash64(h, 0, 1)), x -> shiftrightunsigned(x, 19) < cast(_m * {1 << 45}D as bigint)), x -> {KEY.format(j='0')})"
    d = d.withColumn("_k", F.expr(f"sort_array(case when _m >= 1 then {few} else {many} end)"))
    least = "filter(_k, (x, i) -> i = 0 or shiftright(x, 56) <> shiftright(_k[i - 1], 56))"
    d = d.withColumn(name, F.expr(f"transform({least}, x -> cast(shiftright(x, 56) * 65536L + (x & 65535L) as int))"))
    return d.select(*kept, name)

def _uniform(h: str, shift: int) -> str:
    return f"(((shiftrightunsigned({h}, {shift}) & 2097151L) + 0.5D) / 2097152D)"


def sign_by_gamma(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``sign`` by Ioffe's draws, one of each term for each sample."""
    kept = docs.columns
    d = docs.withColumn("_w", F.expr(words_sql(text)))
    d = d.withColumn("_s", F.expr(TERMS)).withColumn("_u", F.expr(RUNS))
    h1, h2 = "xxhash64(_s[i], k, 1)", "xxhash64(_s[i], k, 2)"
    r = f"(0D - ln({_uniform(h1, 0)} * {_uniform(h1, 21)}))"
    c = f"(0D - ln({_uniform(h1, 42)} * {_uniform(h2, 0)}))"
    b = _uniform(h2, 21)
    t = f"transform(transform(array({r}), r -> struct(r, floor(ln(e - i) / r + {b}) as t)), d -> cast((ln({c}) - d.r * (d.t - {b} + 1D) + 70D) * 2147483648D as bigint) * 65536L + (xxhash64(_s[i], k, d.t) & 65535L))[0]"
    drawn = f"array_min(zip_with(slice(_u, 1, size(_u) - 1), slice(_u, 2, size(_u)), (i, e) -> {t}))"
    d = d.withColumn(name, F.expr(f"transform(sequence(0, {SAMPLES - 1}), k -> cast(k * 65536L + ({drawn} & 65535L) as int))"))
    return d.select(*kept, name)


def fingerprint(sig: str) -> F.Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 6, "0")), "")


def likeness(a: str, b: str) -> F.Column:
    """Equal samples over used bins, of two signatures."""
    used = lambda s: F.transform(s, lambda x: F.shiftright(x, 16))
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(used(a), used(b)))


def followers(docs: DataFrame) -> DataFrame:
    """For each distinct (doc_id, text hash) ``_id, _h``: the document it follows in descending
    order (``_to_id, _to_h``) and how many code points that one asks of it (``_need``).

    The last is followed by the first. Only ids and lengths are ordered, by range.
    """
    keys = docs.groupBy("_id", "_h").agg(F.max("_n").alias("_n"))
    order = [F.col("_id").desc(), F.col("_h").desc()]
    at = U.materialize(U.with_rank(keys, order), "order").select("_id", "_h", "_n", "rank")
    last = at.agg(F.max("rank")).first()[0] or 0
    before = at.select((F.when(F.col("rank") == last, -1).otherwise(F.col("rank")) + 1).alias("rank"), F.col("_id").alias("_to_id"), F.col("_h").alias("_to_h"), F.floor(F.col("_n") / 2).cast("int").alias("_need"))
    return at.drop("_n").join(before, "rank").drop("rank")


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of ``docs(doc_id, text)``, of each edited text and the likeness to it and the next document."""
    text = F.coalesce("text", F.lit(""))
    # keys are never null, so that equality joins, the window and the exchanges of texts agree
    key = [F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64("text", F.isnull("doc_id")).alias("_h")]
    base = docs.select(*key, F.isnull("doc_id").alias("_null"), text.alias("_text"))
    follow = followers(base.select("_id", "_h", F.length("_text").alias("_n")))
    signed = sign(base, "_text", "_sig")
    # the first of repeated rows; lag keeps the exchange below it the one that is used again
    first = F.lag(F.lit(1)).over(Window.partitionBy("_id", "_h").orderBy("_null")).isNull()
    giver = signed.withColumn("_k", first).where("_k").drop("_k")
    given = giver.join(follow, ["_id", "_h"]).select(
        F.col("_to_id").alias("_id"), F.col("_to_h").alias("_h"), F.expr("substring(_text, 1, _need)").alias("_put"), F.col("_sig").alias("_next")
    )
    both = signed.join(given, ["_id", "_h"])
    edited = both.withColumn("_edit", F.expr("concat(left(_text, length(_text) - length(_text) div 2), _put)"))
    edited = sign(edited, "_edit", "_edit_sig")
    return edited.select(
        F.when(~F.col("_null"), F.col("_id")).alias("doc_id"),
        F.length("_text").cast("long").alias("n_chars"),
        F.sha2("_edit", 256).alias("edited_sha256"),
        fingerprint("_sig").alias("fingerprint"),
        fingerprint("_edit_sig").alias("edited_fingerprint"),
        likeness("_sig", "_edit_sig").alias("near_edited"),
        likeness("_sig", "_next").alias("near_next"),
    )


def op4_cws_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compare(U.read(spark, sf_dir, "documents").select("doc_id", "text"))
