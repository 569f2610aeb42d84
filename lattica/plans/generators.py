"""Generated data sets and their SQL: both draw the same numbers, which depend on id, seed and name alone."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import synth
from .oracle import rounded

QUERIES: dict = {}
SQL: dict[str, str] = {}


def u(name: str, seed: int = 1) -> str:
    return f"(('0x' || substring(md5(id || ':{seed}:{name}'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


def normal(name: str) -> str:
    return f"(sqrt(-2 * ln(1 - {u(name + '1')})) * cos(2 * pi() * {u(name + '2')}))"


def query(name: str, rows: int, columns: dict[str, str], make, given: str = ""):
    """Registers a set of ``rows`` points; ``given``: further columns, in terms of which ``columns`` are."""
    doubles = [c for c in columns if c not in ("class", "cluster", "i", "j")]
    shown = ", ".join(f"round({e}, 6) AS {c}" if c in doubles else f"({e})::{'BIGINT' if c in ('i', 'j') else 'INT'} AS {c}" for c, e in columns.items())
    inner = f"SELECT range AS id, {given} FROM (SELECT range, range AS id FROM range({rows}))" if given else f"SELECT range AS id FROM range({rows})"
    SQL[name] = f"SELECT id, {shown} FROM ({inner})"
    QUERIES[name] = lambda spark, d: rounded(make(spark), *doubles)


query("circles", 1000, {"x": "0.5 + r * cos(a)", "y": "0.5 + r * sin(a)", "value": "(ring % 2)::DOUBLE", "class": "ring"}, lambda s: synth.circles(s, 1000, 4, 1),
      f"0.5 * sqrt({u('r')}) AS r, 2 * pi() * {u('a')} AS a, least(floor(0.5 * sqrt({u('r')}) / 0.125), 3)::INT AS ring")

WIDTHS, NOISE = [1.0, 2.0, 0.5, 1.5], [0.1, 0.0, 0.4, 0.2]
_START, _WIDTH, _NOISE = ("[" + ", ".join(f"{x}::DOUBLE" for x in xs) + "][c + 1]" for xs in ([0.0, 1.0, 3.0, 3.5], WIDTHS, NOISE))
_STRIP = {"x": f"{_START} + {_WIDTH} * {u('x')}", "y": f"2.0 * {u('y')}", "value": f"CASE WHEN c % 2 = 0 THEN 1.0 ELSE 0.0 END + {_NOISE} * ({u('v')} - 0.5)", "class": "c"}
query("strips", 1000, _STRIP, lambda s: synth.strips(s, 1000, WIDTHS, NOISE, 2.0, 1), f"CASE WHEN {u('c')} * 5 >= 3.5 THEN 3 WHEN {u('c')} * 5 >= 3 THEN 2 WHEN {u('c')} * 5 >= 1 THEN 1 ELSE 0 END AS c")
query("strips_equal", 1000, _STRIP, lambda s: synth.strips(s, 1000, WIDTHS, NOISE, 2.0, 1, True), f"floor({u('c')} * 4)::INT AS c")
query("density_strips", 1000, {"x": f"(c + {u('x')}) * 0.75", "y": u("y"), "value": f"CASE WHEN c % 2 = 0 THEN 0.0 ELSE 1 + 0.2 * ({u('v')} - 0.5) END", "class": "c"},
      lambda s: synth.density_strips(s, 2000, 4, 0.8, 0.2, 3.0, 1.0, 1), "CASE WHEN id >= 900 THEN 3 WHEN id >= 500 THEN 2 WHEN id >= 400 THEN 1 ELSE 0 END AS c")

_X, _Y = u("x"), u("y")
query("diamond", 1000, {"x": "a", "y": "b", "value": "CASE WHEN c = 0 THEN 0.0 ELSE 1.0 END", "class": "c"}, lambda s: synth.diamond(s, 1000, 1),
      f"{_X} AS a, {_Y} AS b, CASE WHEN {_X} + {_Y} < 0.5 THEN 1 WHEN {_Y} + 1 - {_X} < 0.5 THEN 2 WHEN 1 - {_Y} + {_X} < 0.5 THEN 3 WHEN 2 - {_X} - {_Y} < 0.5 THEN 4 ELSE 0 END AS c")
query("diamond_equal", 1000, {"x": "CASE WHEN c = 0 THEN 0.5 + (a - b) / 2 WHEN c IN (2, 4) THEN 1 - p ELSE p END", "y": "CASE WHEN c = 0 THEN (a + b) / 2 WHEN c IN (3, 4) THEN 1 - q ELSE q END", "value": "CASE WHEN c = 0 THEN 0.0 ELSE 1.0 END", "class": "c"},
      lambda s: synth.diamond(s, 1000, 1, True),
      f"{_X} AS a, {_Y} AS b, floor(5 * {u('c')})::INT AS c, 0.5 * CASE WHEN {_X} + {_Y} > 1 THEN 1 - {_X} ELSE {_X} END AS p, 0.5 * CASE WHEN {_X} + {_Y} > 1 THEN 1 - {_Y} ELSE {_Y} END AS q")
query("space_time_cube", 1000, {"x": _X, "y": _Y, "z": u("z"), "s": "CASE WHEN c = 0 THEN 1.0 ELSE 0.0 END", "class": "c"}, lambda s: synth.space_time_cube(s, 1000, 0.1, 0.05, 1),
      f"CASE WHEN {_X} < 0.4 AND {u('z')} < 0.45 THEN 1 WHEN {_X} > 0.6 AND {u('z')} < 0.45 THEN 2 WHEN {_X} < 0.4 AND {u('z')} > 0.55 THEN 3 WHEN {_X} > 0.6 AND {u('z')} > 0.55 THEN 4 ELSE 0 END AS c")
_VALUE = {"value": "CASE WHEN c = 1 THEN 0.0 ELSE 1.0 END", "class": "c"}
query("l_shape", 1000, {"x": f"2 * {_X}", "y": _Y, **_VALUE}, lambda s: synth.l_shape(s, 1000, 1), f"CASE WHEN {_X} > 0.75 THEN 2 WHEN {_X} > 0.5 THEN 1 WHEN {_X} < 0.25 THEN 0 WHEN {_Y} > 0.5 THEN 1 ELSE 0 END AS c")
query("t_shape", 800, {"x": "a", "y": "b", **_VALUE}, lambda s: synth.t_shape(s, 800, 1),
      f"6 * {_X} AS a, 5 * {_Y} AS b, CASE WHEN 6 * {_X} < 1 OR (6 * {_X} < 4 AND 5 * {_Y} < 1) OR (6 * {_X} < 4 AND 5 * {_Y} > 4) THEN 0 WHEN 6 * {_X} > 5 OR (6 * {_X} > 2 AND 5 * {_Y} > 2 AND 5 * {_Y} < 3) THEN 2 ELSE 1 END AS c")
query("half_noise", 1000, {"x": f"0.5 * {_X} + 0.5 * c", "y": _Y, "value": f"CASE WHEN c = 1 THEN {u('v')} ELSE 0.0 END", "class": "c"}, lambda s: synth.half_noise(s, 500, 1), "(id // 500)::INT AS c")
query("spread_squares", 2000, {
    "x": f"CASE WHEN c = 0 THEN 0.5 WHEN c = 1 THEN {_X} + 1 WHEN c = 2 THEN 1.5 ELSE {_X} END", "y": f"CASE WHEN c = 0 THEN 0.5 WHEN c = 1 THEN {_Y} WHEN c = 2 THEN 1.5 ELSE {_Y} + 1 END",
    "value": f"CASE WHEN c IN (0, 3) THEN {u('v')} ELSE 0.5 END", "class": "c",
}, lambda s: synth.spread_squares(s, 500, 1), "(id // 500)::INT AS c")
query("random_surface", 1000, {"x": "a", "y": "b", "z": f"(a * a * exp(-a * a - (b + 1) * (b + 1)) - (0.2 * a - a ** 3 - b ** 5) * exp(-a * a - b * b)) * (1 + {normal('e')})"}, lambda s: synth.random_surface(s, 1000, 1), f"4 * {_X} - 2 AS a, 4 * {_Y} - 2 AS b")

MEANS, COVARIANCES = [(-0.3, 0.0), (1.2, 2.0)], [((1.0, 0.2), (0.2, 0.9)), ((0.8, -0.4), (-0.4, 0.7))]
_D1 = "exp(-(0.9 * (a + 0.3) ** 2 - 0.4 * (a + 0.3) * b + b ** 2) / (2 * 0.86)) / (2 * pi() * sqrt(0.86))"
_D2 = "exp(-(0.7 * (a - 1.2) ** 2 + 0.8 * (a - 1.2) * (b - 2) + 0.8 * (b - 2) ** 2) / (2 * 0.4)) / (2 * pi() * sqrt(0.4))"
query("mixture_density", 1000, {"x": "a", "y": "b", "value": f"greatest({_D1}, {_D2})"}, lambda s: synth.mixture_density(s, 1000, MEANS, COVARIANCES, 1), f"4 * {_X} - 2 AS a, 4 * {_Y} - 2 AS b")
query("mixture", 1000, {"x": "([-0.3, 1.2]::DOUBLE[])[c + 1] + p", "y": "([0.0, 2.0]::DOUBLE[])[c + 1] + q", "value": "(max(sqrt(p * p + q * q)) OVER () - sqrt(p * p + q * q)) / (max(sqrt(p * p + q * q)) OVER () - min(sqrt(p * p + q * q)) OVER ())", "class": "c"}, lambda s: synth.mixture(s, 500, MEANS, COVARIANCES, 1),
      f"(id // 500)::INT AS c, CASE WHEN id < 500 THEN 1.0 ELSE sqrt(0.8) END * {normal('x')} AS p, CASE WHEN id < 500 THEN 0.2 * {normal('x')} + sqrt(0.9 - 0.04) * {normal('y')} ELSE -0.4 / sqrt(0.8) * {normal('x')} + sqrt(0.7 - 0.2) * {normal('y')} END AS q")
query("squareville_gradient", 231, {"x": "id // 21 / 10.0::DOUBLE", "y": "id % 21 / 10.0::DOUBLE", "value": "CASE WHEN c = 1 THEN 1 - id // 21 / 10.0::DOUBLE ELSE id // 21 / 10.0::DOUBLE END", "class": "c"}, synth.squareville_gradient, "CASE WHEN id % 21 < 6 THEN 0 WHEN id % 21 < 15 THEN 1 ELSE 2 END AS c")
query("outliers", 420, {
    "x": f"CASE WHEN k = 1 THEN {_X} + f WHEN k = 2 AND (b >= a) <> (c = 1) THEN b ELSE a END", "y": f"CASE WHEN k = 1 THEN {_Y} + f WHEN k = 2 AND (b >= a) <> (c = 1) THEN a ELSE b END",
    "value": "CASE WHEN k = 2 THEN -f WHEN c = 0 THEN 1.0 ELSE -1.0 END", "class": "c",
}, lambda s: synth.outliers(s, 1), f"2 * {_X} - 1 AS a, 2 * {_Y} - 1 AS b, CASE WHEN id < 400 THEN 0 WHEN id < 410 THEN 1 ELSE 2 END AS k, CASE WHEN id < 400 THEN CASE WHEN 2 * {_Y} - 1 >= 2 * {_X} - 1 THEN 1 ELSE 0 END WHEN (id - 400) // 5 % 2 = 1 THEN 1 ELSE 0 END AS c, CASE WHEN CASE WHEN id < 400 THEN CASE WHEN 2 * {_Y} - 1 >= 2 * {_X} - 1 THEN 1 ELSE 0 END WHEN (id - 400) // 5 % 2 = 1 THEN 1 ELSE 0 END = 0 THEN 10.0 ELSE -10.0 END AS f")
query("squares", 1000, {"x": _X, "y": _Y, "value": "((c * 7) % 16)::DOUBLE", "cluster": "c"}, lambda s: synth.squares(s, 1000, 4, 1), f"(floor({_X} * 4) * 4 + floor({_Y} * 4))::INT AS c")

SQL["voronoi_regions"] = f"""WITH s AS (SELECT range::INT AS k, 70 * {u('sx').replace('id', 'range')} AS sx, 70 * {u('sy').replace('id', 'range')} AS sy FROM range(100)),
c AS (SELECT range AS id, range // 70 AS i, range % 70 AS j FROM range(4900)),
n AS (SELECT id, i, j, k, row_number() OVER (PARTITION BY id ORDER BY (i - sx) * (i - sx) + (j - sy) * (j - sy), k) AS r FROM c, s)
SELECT id, i, j, round(k + 0.1 * ({u('v')} - 0.5), 6) AS value, k AS class FROM n WHERE r = 1"""
QUERIES["voronoi_regions"] = lambda spark, d: rounded(synth.voronoi_regions(spark, 70, 100, 0.1, 1), "value").withColumns({c: F.col(c).cast("long") for c in ("i", "j")})
