"""Projection, completeness and scaling of tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRANSFORMS = ("none", "zscore", "scale01", "sqrt", "log", "log1")


def pack(df: DataFrame, sample_id: str, columns: list[str], name: str = "x") -> DataFrame:
    """``sample_id`` and the columns as one vector of doubles; NaN becomes null."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns]
    return df.select(F.col(sample_id).alias("sample_id"), F.array(*clean).alias(name))


def complete_cases(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows without null or NaN in the columns."""
    bad = [F.col(c).isNull() | (F.isnan(c) if t in ("double", "float") else F.lit(False)) for c, t in df.dtypes if columns is None or c in columns]
    return df.where(~reduce(lambda a, b: a | b, bad)) if bad else df


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """min, mean, max and sample standard deviation, a row a column, in one pass."""
    stats = df.agg(*(F.struct(F.lit(c).alias("name"), F.min(c).cast("double").alias("lo"), F.avg(c).alias("mean"), F.max(c).cast("double").alias("hi"), F.stddev_samp(c).alias("sd")).alias(c) for c in columns))
    return stats.select(F.inline(F.array(*columns)))


class Scaler:
    """A chain of transforms for each column; statistics are taken before each step, in one pass a step.

    A column without spread becomes 0 by zscore and scale01 and comes back as its value; a column
    without values, as in an empty table, has no statistics and stays null. Nulls stay null.
    """

    def __init__(self, columns: list[str], chain: list[str]):
        if unknown := [t for t in chain if t not in TRANSFORMS]:
            raise ValueError(f"unsupported transform: {unknown}")
        self.columns, self.chain, self.fitted = columns, chain, []

    def fit(self, df: DataFrame) -> Scaler:
        self.fitted = []
        for kind in self.chain:
            stats = {}
            if kind in ("zscore", "scale01"):
                a, b = (F.avg, F.stddev_samp) if kind == "zscore" else (F.min, F.max)
                row = df.agg(*(f(c).cast("double").alias(f"{k}{i}") for i, c in enumerate(self.columns) for k, f in (("a", a), ("b", b)))).first()
                for i, c in enumerate(self.columns):
                    a_, b_ = row[f"a{i}"], row[f"b{i}"]
                    spread = None if a_ is None else b_ - a_ if kind == "scale01" else b_ or 0.0  # one value has no deviation
                    stats[c] = (a_, spread)
            self.fitted.append((kind, stats))
            df = self._apply(df, kind, stats, False)
        return self

    def _apply(self, df: DataFrame, kind: str, stats: dict, back: bool) -> DataFrame:
        def one(c):
            x = F.col(c).cast("double")
            if kind in ("zscore", "scale01"):
                at, by = (F.lit(None).cast("double") if v is None else F.lit(float(v)) for v in stats[c])
                return x * by + at if back else F.when(by == 0, x - at).otherwise((x - at) / F.nullif(by, F.lit(0.0)))
            forth = {"none": lambda v: v, "sqrt": F.sqrt, "log": F.ln, "log1": F.log1p}
            undo = {"none": lambda v: v, "sqrt": lambda v: v * v, "log": F.exp, "log1": F.expm1}
            return (undo if back else forth)[kind](x)

        return df.withColumns({c: one(c) for c in self.columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: self._apply(d, *s, False), self.fitted, df)

    def inverse(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, s: self._apply(d, *s, True), reversed(self.fitted), df)


class ColumnScaler:
    """A chain of its own for each column, as ``{column: [transforms]}``; columns not named stay as they are.
    Columns in ``together`` are coordinates: they share one mode (``zscore``, ``scale01`` or None) that
    keeps their aspect."""

    def __init__(self, chains: dict[str, list[str]], together: tuple[str, ...] = (), mode: str | None = None):
        if set(together) & set(chains):
            raise ValueError("a column is scaled either alone or together with others")
        if mode not in (None, "zscore", "scale01"):
            raise ValueError(f"unsupported mode: {mode}")
        self.scalers = [Scaler([c], chain) for c, chain in chains.items()]
        self.together, self.mode = list(together), mode

    def fit(self, df: DataFrame) -> ColumnScaler:
        for s in self.scalers:
            s.fit(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        df = reduce(lambda d, s: s.transform(d), self.scalers, df)
        if self.mode and self.together:
            df = (geo_zscore if self.mode == "zscore" else geo_scale01)(df, self.together)
        return df


def except_intercept(columns: list[str]) -> list[str]:
    """The columns to scale of a matrix whose last one is the intercept."""
    return columns[:-1]


def drop_positions(df: DataFrame, positions: set[int]) -> DataFrame:
    """The columns but those at ``positions`` (from 0); no such column is an error."""
    if wrong := [p for p in positions if not 0 <= p < len(df.columns)]:
        raise ValueError(f"no columns at {wrong}")
    return df.select(*(F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in positions))


def keep_positions(df: DataFrame, positions: list[int]) -> DataFrame:
    """The columns at ``positions`` (from 0), in their own order."""
    return drop_positions(df, set(range(len(df.columns))) - set(positions)) if all(0 <= p < len(df.columns) for p in positions) else drop_positions(df, set(positions))


def geo_scale01(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shifts each axis to 0 and divides all by the largest range, which keeps the aspect; where no axis
    has a range all is 0, and a column without values stays null."""
    s = df.agg(*(f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    span = max((s[f"hi{i}"] - s[f"lo{i}"] for i in range(len(columns)) if s[f"lo{i}"] is not None), default=0.0) or 1.0
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(s[f"lo{i}"]).cast("double")) / F.lit(span) for i, c in enumerate(columns)})


def geo_zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Centres each axis and divides all by one shared deviation, sqrt(sum of squared distances / (n - 1));
    where there is none all is 0, and a column without values stays null."""
    s = df.agg(F.sqrt(reduce(lambda a, b: a + b, (F.coalesce(F.var_samp(c), F.lit(0.0)) for c in columns))).alias("sd"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns))).first()
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(s[f"m{i}"]).cast("double")) / F.lit(s["sd"] or 1.0) for i, c in enumerate(columns)})
