"""Query registry: one Spark callable and, where SQL can say it, one SQL text per operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, use: str = "", rnd: str = "", digits: int = 6):
    """Register ``fn(t) -> DataFrame`` under ``name``.

    ``use`` names the shared input CTEs the SQL starts from; ``rnd`` lists the double columns both
    sides round, since float sums depend on the order of addition, and ``@name`` a time column both sides print.
    """
    from factorspark.plans.inputs import Inputs, with_ctes

    cols = [c for c in rnd.split() if not c.startswith("@")]
    times = [c[1:] for c in rnd.split() if c.startswith("@")]

    # Cent-valued data often lands exactly on a rounding tie, where one ulp decides; a shift of a sixth of
    # the last digit moves ties off the edge, the same way on both sides.
    shift = 0.17 * 10 ** -digits

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(Inputs(spark, sf_dir))
            fixed = {c: f"round(cast(`{c}` AS DOUBLE) + {shift:.12f}D, {digits}) + 0D AS `{c}`" for c in cols}
            fixed |= {c: f"date_format(`{c}`, 'yyyy-MM-dd HH:mm:ss') AS `{c}`" for c in times}
            return df.selectExpr(*[fixed.get(c, f"`{c}`") for c in df.columns]) if fixed else df

        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = run
        if sql is not None:
            body = sql.strip()
            if cols or times:
                rep = ", ".join([f"round(CAST({c} AS DOUBLE) + {shift!r}, {digits}) + 0.0 AS {c}" for c in cols]
                                + [f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}" for c in times])
                body = f"SELECT * REPLACE ({rep}) FROM (\n{body}\n)"
            ORACLE[name] = with_ctes(use, body)
        return fn

    return deco
