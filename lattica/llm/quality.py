"""Quality classifier: logistic regression over hashed word n-grams, trained with FTRL-Proximal.

Tokens are runs of letters, digits and non-ASCII characters (A-Z lower-cased) and runs of
other visible characters; a token equal to the one before it is written ``=``. Tokens and
pairs of tokens are hashed into ``2**bits`` weights; a text's score is the logistic of the
sum of its n-grams' weights over the root of their number, plus a bias: a sparse dot product.

Training takes the ``max_train`` labelled rows that come first by a hash of doc_id (a bounded
sample; the bound is a parameter), extracts their n-grams in parallel and runs the sequential
updates in one task. Weights (4 bytes each) are the only thing broadcast. Scoring is a map.

Defined cases: null and empty texts have no n-grams and get the bias's score; labels that are
null are not learnt from; a doc_id labelled twice counts twice; without labels every score is 0.5.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _util as U

TOKEN = re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x00-\x20]+")
CACHE_WORDS = 200_000


class Tokens:
    """32-bit token codes, kept for a task; the cache only saves work."""

    def __init__(self):
        self.codes: dict[bytes, int] = {}

    def __call__(self, tokens: list[bytes]) -> np.ndarray:
        held = self.codes
        try:
            return np.fromiter(map(held.__getitem__, tokens), np.uint64, len(tokens))
        except KeyError:
            if len(held) > CACHE_WORDS:
                held.clear()
            for t in set(tokens):
                if t not in held:
                    held[t] = zlib.crc32(t)
            return np.fromiter(map(held.__getitem__, tokens), np.uint64, len(tokens))


SAME = np.uint64(0x3D)
MIX = np.uint64(0x9E3779B97F4A7C15)


def features(texts: list[bytes], bits: int, codes: Tokens | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams, text after text (tokens, then pairs), and the number of each text's."""
    tokens = [TOKEN.findall(t.lower()) for t in texts]
    n = np.fromiter(map(len, tokens), np.int64, len(tokens))
    code = (codes or Tokens())([t for ts in tokens for t in ts])
    first = np.zeros(len(code), bool)
    starts = np.cumsum(n) - n
    first[starts[n > 0]] = True
    same = np.zeros(len(code), bool)
    same[1:] = (code[1:] == code[:-1]) & ~first[1:]
    code = np.where(same, SAME, code)
    shift = np.uint64(64 - bits)
    one = (code * MIX) >> shift
    prev = np.concatenate((np.zeros(min(1, len(code)), np.uint64), code[:-1]))
    prev = np.where(first, np.uint64(0), prev)
    two = ((prev * np.uint64(0xC2B2AE3D27D4EB4F) + code + np.uint64(1)) * MIX) >> shift
    both = np.empty(2 * len(code), np.int64)
    at = np.arange(len(code)) + np.repeat(starts, n)
    both[at] = one
    both[at + np.repeat(n, n)] = two
    return both, 2 * n


class Ftrl:
    """Per-coordinate FTRL-Proximal (McMahan et al., 2013) for logistic loss."""

    def __init__(self, bits: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows, bits: int, epochs: int) -> np.ndarray:
    """Weights, the bias last, from (slots, label) rows in the given order."""
    model = Ftrl(bits)
    prepared = []
    for slots, y in rows:
        at, count = np.unique(slots, return_counts=True)
        prepared.append((np.append(at, 1 << bits).astype(np.int32), np.append(count / np.sqrt(max(1, len(slots))), 1.0).astype(np.float32), y))
    for _ in range(epochs):
        for at, x, y in prepared:
            model.learn(at, x.astype(np.float64), y)
    return model.weights().astype(np.float32)


def logits(texts: list[bytes], weights: np.ndarray, bits: int, codes: Tokens | None = None) -> np.ndarray:
    slots, n = features(texts, bits, codes)
    total = np.zeros(len(texts))
    some = n > 0
    if some.any():
        total[some] = np.add.reduceat(weights[slots].astype(np.float64), (np.cumsum(n) - n)[some])
    return total / np.sqrt(np.maximum(n, 1)) + float(weights[1 << bits])


def _extract(bits: int):
    def extract(batches):
        codes = Tokens()
        for b in batches:
            slots = [features([t], bits, codes)[0].astype("<u4").tobytes() for texts in U.text_slices(b.column("text")) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("order"), b.column("label"), pa.array(slots, pa.binary())], names=["order", "label", "slots"])

    return extract


def _fit(bits: int, epochs: int):
    def run(table):
        rows = sorted(zip(table["order"].to_pylist(), table["label"].to_pylist(), table["slots"].to_pylist(), strict=True))
        w = fit(((np.frombuffer(s, "<u4").astype(np.int64), y) for _, y, s in rows), bits, epochs)
        del rows
        U.release()
        return pa.table({"weights": pa.array([w.tobytes()], pa.binary())})

    return run


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", bits: int = 18, max_train: int = 10_000, epochs: int = 3) -> np.ndarray:
    """Weights from ``labels(doc_id, <label>)`` joined with ``docs(doc_id, text)``."""
    order = F.xxhash64("doc_id")
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"), order.alias("order"))
    chosen = chosen.orderBy("order", "label").limit(max_train)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("order", "label", "text")
    slots = rows.mapInArrow(_extract(bits), "order long, label int, slots binary")
    found = slots.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(_fit(bits, epochs), "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros((1 << bits) + 1, np.float32)


def _score(weights, bits: int, keep: list[str]):
    def run(batches):
        w, codes = weights.value, Tokens()
        for b in batches:
            score = []
            for texts in U.text_slices(b.column("text"), 1 << 20):
                score.append(1 / (1 + np.exp(-np.clip(logits(texts, w, bits, codes), -35, 35))))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.concatenate(score or [np.zeros(0)]))], names=[*keep, "_score"])
        b = score = codes = None
        U.release()

    return run


def score(docs: DataFrame, weights: np.ndarray, *, bits: int = 18, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with _score in (0, 1)."""
    keep = keep if keep is not None else [c for c in docs.columns if c != "_score"]
    held = docs.sparkSession.sparkContext.broadcast(weights)
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("_score", T.DoubleType())])
    return docs.select(*(f"`{c}`" for c in dict.fromkeys([*keep, "text"]))).mapInArrow(_score(held, bits, keep), schema)


def accept(docs: DataFrame, weights: np.ndarray, least: float = 0.5, **options) -> DataFrame:
    """``docs`` that score ``least`` or more, with their columns, whatever their names."""

    def kept(docs):
        return score(docs, weights, **options).where(F.col("_score") >= least).drop("_score")

    return U.sheltered(docs, kept)


def op8_quality(spark, sf_dir: str) -> DataFrame:
    """Learns from labels whose crc32(doc_id) mod 3 is not 1; scores all documents."""
    docs = U.read(spark, sf_dir, "documents").select("doc_id", "text")
    w = train(docs, U.read(spark, sf_dir, "labels").where(U.train_flag(3, 1)))
    out = score(docs, w, keep=["doc_id"])
    return out.select("doc_id", (~U.train_flag(3, 1)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= 0.5).cast("int").alias("predicted"))
