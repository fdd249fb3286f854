"""Factor registry and batch computation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factorspark.functions.math import div, log1p
from factorspark.operators.windows import RN, Roll

# Windows per select; more would only make generated methods too large to compile.
CHUNK = 60


@dataclass(frozen=True)
class Factor:
    name: str
    category: str
    build: Callable[[Roll], Column]
    inputs: tuple[str, ...]
    needs: tuple[str, ...] = ()


FACTORS: dict[str, Factor] = {}
SETS: dict[str, list[str]] = {}

# Helper columns a factor may read. A window inside a window needs its own select; helpers are computed
# first, over the same partition and order, so they add no exchange.
HELPERS: dict[str, Callable[[Roll], Column]] = {
    RN: lambda r: F.row_number().over(r.all),
    "_c1": lambda r: r.ref("close", 1),
    "_v1": lambda r: r.ref("volume", 1),
    "_up": lambda r: F.when(F.col("_c1").isNotNull(), F.greatest(F.col("close") - F.col("_c1"), F.lit(0.0))),
    "_down": lambda r: F.when(F.col("_c1").isNotNull(), F.greatest(F.col("_c1") - F.col("close"), F.lit(0.0))),
    "_vup": lambda r: F.when(F.col("_v1").isNotNull(), F.greatest(F.col("volume") - F.col("_v1"), F.lit(0.0))),
    "_vdown": lambda r: F.when(F.col("_v1").isNotNull(), F.greatest(F.col("_v1") - F.col("volume"), F.lit(0.0))),
    "_ratio": lambda r: div(F.col("close"), F.col("_c1")),
    "_lv": lambda r: log1p(F.col("volume")),
    "_lvr": lambda r: log1p(div(F.col("volume"), F.col("_v1"))),
    "_moved": lambda r: F.abs(F.col("_ratio") - 1) * F.col("volume"),
    "_back": lambda r: div(F.col("_c1"), F.col("close")) - 1,
    "_tr": lambda r: F.when(F.col("_c1").isNotNull(), F.greatest(
        F.col("high") - F.col("low"), F.abs(F.col("high") - F.col("_c1")), F.abs(F.col("low") - F.col("_c1")))),
    "_tp": lambda r: (F.col("high") + F.col("low") + F.col("close")) / 3,
    "_macd": lambda r: r.ema("close", 12) - r.ema("close", 26),
    "_oi1": lambda r: div(F.col("open_interest"), r.ref("open_interest", 1)) - 1,
    "_liq": lambda r: F.col("liquidation_long") + F.col("liquidation_short"),
    "_net": lambda r: (F.col("buy_volume") - F.col("sell_volume")) / (F.col("buy_volume") + F.col("sell_volume") + 1e-10),
    "_fpos": lambda r: F.coalesce(F.col("funding_rate") > 0, F.lit(False)).cast("int"),
    "_frun": lambda r: F.sum(1 - F.col("_fpos")).over(r.cum),
}
HELPER_DEPS = {
    "_up": ("_c1",), "_down": ("_c1",), "_ratio": ("_c1",), "_moved": ("_c1", "_ratio"), "_back": ("_c1",), "_tr": ("_c1",),
    "_macd": (RN,), "_vup": ("_v1",), "_vdown": ("_v1",), "_lvr": ("_v1",), "_frun": ("_fpos",),
}


def register_factor(name: str, category: str, inputs=("close",), needs=(), sets=()):
    """Register a user factor: a function of the rolling builders that returns a Column."""

    def deco(fn: Callable[[Roll], Column]):
        if name in FACTORS:
            raise ValueError(f"factor {name} is already registered")
        FACTORS[name] = Factor(name, category, fn, tuple(inputs), tuple(needs))
        SETS.setdefault(category, []).append(name)
        for s in sets:
            SETS.setdefault(s, []).append(name)
        return fn

    return deco


def _ordered_helpers(factors: list[Factor]) -> list[str]:
    want: list[str] = []

    def add(h: str):
        for d in HELPER_DEPS.get(h, ()):
            add(d)
        if h not in want:
            want.append(h)

    for f in factors:
        for h in f.needs:
            add(h)
    return want


def compute_factors(df: DataFrame, names: list[str] | None = None, set_name: str = "all", keys=("symbol", "ts"),
                    roll: Roll | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Keys, kept columns and one column per factor, from one exchange and one sort.

    Unknown names and factors whose input columns are absent are skipped; ``missing_factors`` lists them.
    """
    roll = roll or Roll(keys[0], keys[1])
    pool = names if names is not None else (list(FACTORS) if set_name == "all" else SETS[set_name])
    have = set(df.columns)
    todo = [FACTORS[n] for n in pool if n in FACTORS and set(FACTORS[n].inputs) <= have]
    for h in _ordered_helpers(todo):
        df = df.withColumn(h, HELPERS[h](roll))
    # computed under private names: a factor may be called like the column it reads, up to case
    for i in range(0, len(todo), CHUNK):
        df = df.withColumns({f"_f{i + j}": f.build(roll).cast("double") for j, f in enumerate(todo[i:i + CHUNK])})
    return df.select(*keys, *keep, *[F.col(f"_f{i}").alias(n) for i, n in enumerate(_column_names(todo))])


def _column_names(factors: list[Factor]) -> list[str]:
    """Factor names, with the category in front where two differ only in case (columns ignore case)."""
    seen: set[str] = set()
    out = []
    for f in factors:
        name = f.name if f.name.lower() not in seen else f"{f.category}_{f.name}"
        seen.add(name.lower())
        out.append(name)
    return out


def missing_factors(df: DataFrame, names: list[str]) -> dict[str, str]:
    """Requested factors that cannot be computed on this frame, with the reason (plan metadata only)."""
    out = {}
    for n in names:
        if n not in FACTORS:
            out[n] = "unknown"
        elif lacking := set(FACTORS[n].inputs) - set(df.columns):
            out[n] = "missing columns: " + ", ".join(sorted(lacking))
    return out


def list_factors(spark) -> DataFrame:
    """The registry as a table (name, category, inputs)."""
    rows = [(f.name, f.category, list(f.inputs)) for f in FACTORS.values()]
    return spark.createDataFrame(rows, "name STRING, category STRING, inputs ARRAY<STRING>")
