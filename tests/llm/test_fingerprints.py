"""Signatures against exact generalised Jaccard similarity."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lattica.llm import cws

RNG = random.Random(11)
VOCABULARY = [f"v{i}" for i in range(400)]


def terms(text):
    w = text.split() or [""]
    return Counter(zip(w, [*w[1:], None], strict=True))


def exact(a, b):
    a, b = terms(a), terms(b)
    return sum((a & b).values()) / sum((a | b).values())


def edited(words):
    """Another text: part of the words, some repeated often, some new ones."""
    at = RNG.randrange(len(words))
    kept = words[: max(1, at)]
    extra = [RNG.choice(VOCABULARY) for _ in range(RNG.randrange(1, len(words) + 1))]
    loop = kept[:2] * RNG.randrange(0, 6)
    return kept + loop + extra


def pairs(low, high, n):
    for _ in range(n):
        words = [RNG.choice(VOCABULARY) for _ in range(RNG.randrange(low, high))]
        words += words[:3] * RNG.randrange(0, 4)
        yield " ".join(words), " ".join(edited(words))


@pytest.mark.parametrize("form", [cws.sign, cws.sign_by_gamma])
@pytest.mark.parametrize(("low", "high"), [(2, 32), (32, 128), (128, 1500)])
def test_collisions_are_generalised_jaccard(spark, form, low, high):
    n = 300 if form is cws.sign else 100 if high < 1000 else 40
    rows = [(a, b, exact(a, b)) for a, b in pairs(low, high, n)]
    df = spark.createDataFrame(rows, "a string, b string, exact double").repartition(4)
    got = form(form(df, "a", "x"), "b", "y").select("exact", cws.likeness("x", "y").alias("near"), F.size("x").alias("n")).collect()
    off = [r.near - r.exact for r in got]
    assert sum(map(abs, off)) / n < 0.04
    assert abs(sum(off)) / n < 0.01 if form is cws.sign else abs(sum(off)) / n < 0.02
    assert min(r.n for r in got) >= 0.9 * cws.SAMPLES


def test_weights_count(spark):
    """One heavy term and many light ones: a scheme that forgets weights would be far off."""
    light = " ".join(f"x{i}" for i in range(100))
    rows = [(1, "a a " * 60 + light), (2, "a a " * 60 + " ".join(f"y{i}" for i in range(100)))]
    df = spark.createDataFrame(rows, "id int, text string")
    a, b = (r.s for r in cws.sign(df, "text", "s").orderBy("id").collect())
    near = len(set(a) & set(b)) / cws.SAMPLES
    assert near == pytest.approx(exact(rows[0][1], rows[1][1]), abs=0.13)


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5003}" for i in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long + " end")], "doc_id long, text string")
    rows = cws.compare(df).collect()
    assert all(r.near_next > 0.95 for r in rows)
