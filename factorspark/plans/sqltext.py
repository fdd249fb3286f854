"""Small SQL text builders for rolling expressions."""


def w(n: int, by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def wall(by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order})"


def wcum(by: str = "symbol", order: str = "ts") -> str:
    return f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def roll(agg: str, n: int, *inputs: str, mp: int | None = None) -> str:
    """``agg`` over the last n rows, NULL until n present values."""
    need = n if mp is None else mp
    cond = " AND ".join(f"count({x}) OVER {w(n)} >= {need}" for x in inputs)
    return f"CASE WHEN {cond} THEN {agg} OVER {w(n)} END"


def mean(x, n, mp=None):
    return roll(f"avg({x})", n, x, mp=mp)


def std(x, n, mp=None):
    return roll(f"stddev_samp({x})", n, x, mp=mp)


def zscore(x, n, mp=None):
    return f"({x} - ({mean(x, n, mp)})) / (({std(x, n, max(mp, 2) if mp else None)}) + 1e-10)"


def lag(x, n=1):
    return f"lag({x}, {n}) OVER {wall()}"


def ema(x, n):
    """Over the whole history. Needs column rn; the weights are rescaled by the row number, which cancels in the ratio."""
    keep = 1.0 - 2.0 / (n + 1)
    return (f"(sum({x} * pow({keep!r}, -rn)) OVER {wcum()}) / (sum(CASE WHEN {x} IS NOT NULL THEN pow({keep!r}, -rn) END) OVER {wcum()})")


def avg_rank(x, by):
    """Average rank; callers restrict to rows where x is present."""
    return f"(rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0)"


def moving_corr(x: str, y: str) -> str:
    return f"CASE WHEN var_pop({x}) > 1e-18 AND var_pop({y}) > 1e-18 THEN corr({x}, {y}) END"


def pearson(src: str, by: str, x: str, y: str, min_n: int = 3, name: str = "ic") -> str:
    g, sel = (f"GROUP BY {by}", f"{by}, ") if by else ("", "")
    return f"""SELECT {sel}count(*) AS n, {moving_corr(x, y)} AS {name} FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL {g} HAVING count(*) >= {min_n}"""


def spearman(src: str, by: str, x: str, y: str, min_n: int = 3, name: str = "rank_ic") -> str:
    g, sel, part = (f"GROUP BY {by}", f"{by}, ", by) if by else ("", "", "1")
    return f"""SELECT {sel}count(*) AS n, {moving_corr('rx', 'ry')} AS {name} FROM (
        SELECT {sel}{avg_rank(x, part)} AS rx, {avg_rank(y, part)} AS ry FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL) {g} HAVING count(*) >= {min_n}"""


def norm_cdf(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    poly = f"(((((1.061405429 * {t} - 1.453152027) * {t}) + 1.421413741) * {t} - 0.284496736) * {t} + 0.254829592) * {t}"
    erf = f"(1.0 - {poly} * exp(-({x}) * ({x}) / 2.0))"
    return f"(0.5 * (1.0 + CASE WHEN ({x}) >= 0 THEN {erf} ELSE -{erf} END))"


def norm_ppf(p: str) -> str:
    t = f"sqrt(-2.0 * ln(least({p}, 1.0 - ({p}))))"
    z = f"({t} - (2.515517 + 0.802853 * {t} + 0.010328 * {t} * {t}) / (1.0 + 1.432788 * {t} + 0.189269 * {t} * {t} + 0.001308 * {t} * {t} * {t}))"
    return f"(CASE WHEN ({p}) <= 0 OR ({p}) >= 1 THEN NULL WHEN ({p}) = 0.5 THEN 0.0 WHEN ({p}) > 0.5 THEN {z} ELSE -{z} END)"
