"""Colours for classes. Palettes are ramps between a few anchors, so any number of classes can be asked for."""

from __future__ import annotations

import colorsys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .reshape import numbered

#: Ends of the hue of sequential and diverging ramps, in degrees; each is a rule, not a table of colours.
SEQUENTIAL = {"blues": 215, "greens": 130, "oranges": 28, "purples": 275, "reds": 2, "greys": None}
DIVERGING = {"red_blue": (2, 215), "orange_purple": (28, 275), "red_green": (2, 130), "brown_teal": (35, 180)}
KINDS = ("sequential", "diverging", "qualitative")


def _rgb(hue: float | None, light: float, full: float = 0.65) -> int:
    r, g, b = colorsys.hls_to_rgb((hue or 0) / 360, light, 0.0 if hue is None else full)
    return (round(r * 255) << 16) | (round(g * 255) << 8) | round(b * 255)


def palette(name: str, n: int) -> list[int]:
    """n colours as 0xRRGGBB. ``qualitative`` turns the hue by the golden angle."""
    t = [i / max(n - 1, 1) for i in range(n)]
    if name in SEQUENTIAL:
        return [_rgb(SEQUENTIAL[name], 0.94 - 0.66 * x) for x in t]
    if name in DIVERGING:
        low, high = DIVERGING[name]
        return [_rgb(low if x < 0.5 else high, 0.96 - 0.6 * abs(2 * x - 1)) for x in t]
    if name == "qualitative":
        return [_rgb(i * 137.50776405 % 360, 0.5) for i in range(n)]
    raise ValueError(f"unknown palette: {name}")


def names(kind: str) -> list[str]:
    if kind not in KINDS:
        raise ValueError(f"kind is one of {KINDS}")
    return {"sequential": list(SEQUENTIAL), "diverging": list(DIVERGING), "qualitative": ["qualitative"]}[kind]


def interpolate(colours: list[int], n: int) -> list[int]:
    """n colours along straight lines between the given ones, channel by channel."""
    if n == 1 or len(colours) == 1:
        return [colours[0]] * n
    out = []
    for i in range(n):
        at = i * (len(colours) - 1) / (n - 1)
        k = min(int(at), len(colours) - 2)
        mix = [round((colours[k] >> s & 255) * (1 - (at - k)) + (colours[k + 1] >> s & 255) * (at - k)) for s in (16, 8, 0)]
        out.append(mix[0] << 16 | mix[1] << 8 | mix[2])
    return out


def colour(class_idx: Column, colours: list[int]) -> Column:
    return F.element_at(F.array(*(F.lit(c) for c in colours)), class_idx + 1)


def distinct_classes(values: DataFrame) -> DataFrame:
    """``values(id, v)`` to (id, class_idx): a class for each distinct value, in order; the distinct
    values are numbered, not the rows."""
    ranked = numbered(values.select("v").distinct(), ["v"], "class_idx")
    return values.join(ranked, "v").select("id", "class_idx")


def kmeans_classes(values: DataFrame, n: int, rounds: int = 50) -> DataFrame:
    """``values(id, v)`` to (id, class_idx) by k-means on the line from quantiles; classes in order of
    their centres. Rounds aggregate sums by class, so any number of rows works."""
    start = values.agg(F.percentile_approx("v", [(2 * i + 1) / (2 * n) for i in range(n)], 10_000)).first()[0] or []
    centres = sorted(set(start))
    for _ in range(rounds):
        if len(centres) < 2:
            break
        k = _between(centres)
        rows = values.where("v is not null").groupBy(k.alias("k")).agg(F.avg("v").alias("m")).collect()
        new = list(centres)
        for r in rows:
            new[r["k"]] = r["m"]
        if max(abs(a - b) for a, b in zip(new, centres, strict=True)) <= 1e-9:
            break
        centres = sorted(new)
    return values.select("id", _between(centres).alias("class_idx"))


def _between(centres: list[float]) -> Column:
    """The nearest of sorted centres, the lower one at equal distance."""
    out = F.lit(0)
    for a, b in zip(centres, centres[1:], strict=False):
        out = out + (F.col("v") > (a + b) / 2).cast("int")
    return F.coalesce(out, F.lit(0))
