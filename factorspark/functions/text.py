"""Checks over factor-expression texts, and small string and map helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operators whose last argument is a lag, and those whose last argument is a window.
LAG_OPERATORS = ("delay", "ref", "shift")
WINDOW_OPERATORS = ("max", "mean", "min", "rolling", "std", "sum", "window")
FUTURE_COLUMN = r"(?i)\$(fwd|forward|future|next)_?[a-z0-9_]*"


def calls(c: Column) -> Column:
    """Calls of an expression, inner ones first: array of (name, n, arg) with the lower-case name (empty for plain brackets), the
    number of arguments and the last argument, where each call inside it is written as ``()``. Blanks do not count; a bracket
    without its partner makes no call."""
    words = _words(c)
    level = lambda name, n, arg: F.array(F.struct(name.alias("name"), n.alias("n"), arg.alias("arg")))
    none = F.slice(level(F.lit(""), F.lit(0), F.lit("")), 1, 0)
    start = F.struct(none.alias("open"), none.alias("done"), F.lit("").alias("before"))

    def step(s, w):
        stack = s["open"]
        inner = F.try_element_at(stack, F.lit(-1))
        below = lambda k: F.slice(stack, F.lit(1), F.greatest(F.size(stack) - k, F.lit(0)))
        written = lambda x, more: level(x["name"], x["n"], F.concat(x["arg"], more))
        is_open = F.size(stack) > 0
        outer = F.try_element_at(stack, F.lit(-2))
        after = (F.when(w == "(", F.concat(stack, level(F.when(s["before"].rlike(r"^\w+$"), F.lower(s["before"])).otherwise(""), F.lit(1), F.lit(""))))
                 .when(~is_open, stack)
                 .when((w == ")") & (F.size(stack) > 1), F.concat(below(2), written(outer, F.lit("()"))))
                 .when(w == ")", none)
                 .when(w == ",", F.concat(below(1), level(inner["name"], inner["n"] + 1, F.lit(""))))
                 .otherwise(F.concat(below(1), written(inner, w))))
        done = F.when((w == ")") & is_open, F.concat(s["done"], F.array(inner))).otherwise(s["done"])
        return F.struct(after.alias("open"), done.alias("done"), w.alias("before"))
    return F.aggregate(words, start, step, lambda s: s["done"])


def _negative_last(found: Column, names: tuple[str, ...]) -> Column:
    return F.exists(found, lambda x: x["name"].isin(*names) & (x["n"] > 1) & x["arg"].rlike("^-[0-9]+$"))


def _words(c: Column) -> Column:
    """Words and single signs of an expression, in order; blanks only separate."""
    return F.regexp_extract_all(c, F.lit(r"\w+|[^\w\s]"), F.lit(0))


def _neighbours(c: Column) -> Column:
    """Every word of an expression with the word after it."""
    w = _words(c)
    return F.zip_with(w, F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.struct(a.alias("word"), b.alias("next")))


def operators(c: Column) -> Column:
    """Words with a capital first letter that come right before an opening bracket, in order and with repeats."""
    called = F.filter(_neighbours(c), lambda x: (x["next"] == "(") & F.substring(x["word"], 1, 1).between("A", "Z"))
    return F.transform(called, lambda x: x["word"])


def fields(c: Column) -> Column:
    """Distinct words that come right after a dollar sign, sorted; a number is no name."""
    named = F.filter(_neighbours(c), lambda x: (x["word"] == "$") & F.coalesce(x["next"].rlike(r"^\w"), F.lit(False)) & ~x["next"].rlike(r"^\d"))
    return F.array_sort(F.array_distinct(F.transform(named, lambda x: x["next"])))


def _walk(c: Column) -> Column:
    """Fold over the brackets of a text: current depth, deepest, lowest."""
    chars = F.filter(F.split(c, ""), lambda ch: (ch == "(") | (ch == ")"))
    start = F.struct(F.lit(0).alias("d"), F.lit(0).alias("hi"), F.lit(0).alias("lo"))

    def step(a, ch):
        d = a["d"] + F.when(ch == "(", 1).otherwise(-1)
        return F.struct(d.alias("d"), F.greatest(a["hi"], d).alias("hi"), F.least(a["lo"], d).alias("lo"))
    return F.aggregate(chars, start, step)


def depth(c: Column) -> Column:
    return _walk(c)["hi"]


def balanced(c: Column) -> Column:
    w = _walk(c)
    return (w["d"] == 0) & (w["lo"] == 0)


def audit_expressions(df: DataFrame, text: str = "expr") -> DataFrame:
    """Signs of look-ahead in each expression: a call, nested or not, whose last argument is a negative lag or window, or a column
    named after the future."""
    c = F.col(text)
    d = df.withColumn("_calls", calls(c))
    d = d.withColumns({"negative_lag": _negative_last(F.col("_calls"), LAG_OPERATORS), "negative_window": _negative_last(F.col("_calls"), WINDOW_OPERATORS),
                       "future_column": c.rlike(FUTURE_COLUMN)}).drop("_calls")
    return d.withColumn("biased", F.col("negative_lag") | F.col("negative_window") | F.col("future_column"))


def expression_complexity(df: DataFrame, text: str = "expr", weight: float = 0.1, max_operators: int = 10, max_depth: int = 5) -> DataFrame:
    """Operators, fields, nesting, length, bracket balance, penalty and the over-limit flag."""
    c = F.col(text)
    d = df.withColumns({"n_operators": F.size(operators(c)), "fields": F.array_join(fields(c), ","), "max_depth": depth(c),
                        "length": F.length(c), "balanced": balanced(c)})
    over = lambda x, k: F.greatest(F.col(x) - k, F.lit(0))
    return d.withColumns({"penalty": (over("n_operators", 3) + over("max_depth", 2)) * weight,
                          "exceeds": (F.col("n_operators") > max_operators) | (F.col("max_depth") > max_depth)})


def unknown_fields(df: DataFrame, registry: DataFrame, id_col: str, text: str = "expr") -> DataFrame:
    """Fields used by an expression that the registry (one row per field) does not list."""
    used = df.select(id_col, F.explode(fields(F.col(text))).alias("field"))
    return used.join(registry.select("field"), "field", "left_anti").select(id_col, "field")


def indicator_coverage(df: DataFrame, keywords: dict[str, tuple[str, str]], id_col: str, hypothesis: str = "hypothesis", text: str = "expr") -> DataFrame:
    """Indicators a hypothesis names against those its expression uses; one pass, no join.

    ``keywords`` maps an indicator to (pattern in the hypothesis, pattern in the expression).
    """
    asked = F.array_compact(F.array(*[F.when(F.col(hypothesis).rlike(h), F.lit(k)) for k, (h, _) in keywords.items()]))
    used = F.array_compact(F.array(*[F.when(F.col(text).rlike(e), F.lit(k)) for k, (_, e) in keywords.items()]))
    d = df.withColumns({"_a": asked, "_u": used})
    return d.select(id_col, F.size("_a").alias("requested"), F.size(F.array_intersect("_a", "_u")).alias("implemented"),
                    F.array_join(F.array_sort(F.array_except("_a", "_u")), ",").alias("missing"),
                    F.when(F.size("_a") > 0, F.size(F.array_intersect("_a", "_u")) / F.size("_a")).otherwise(1.0).alias("coverage"))


# Names people write for the catalogue's indicators, and the functions or fields that compute them.
INDICATOR_ALIASES = {
    "RSI": ("rsi", "relative strength index", "relative strength", "overbought", "oversold"),
    "MACD": ("macd", "moving average convergence divergence", "convergence divergence"),
    "MOMENTUM": ("momentum", "mom"), "ROC": ("roc", "rate of change"), "SMA": ("sma", "ma", "moving average", "simple moving average"),
    "EMA": ("ema", "exponential moving average", "exponential average"), "BOLLINGER": ("bollinger", "bollinger band", "bollinger bands", "bbands"),
    "ATR": ("atr", "average true range", "true range"), "STOCHASTIC_K": ("stochastic", "stochastics", "stochastic oscillator", "kdj"),
    "WILLIAMS_R": ("williams", "williams r", "percent r"), "CCI": ("cci", "commodity channel index", "commodity channel"),
    "VOLUME_RATIO": ("volume ratio", "relative volume", "volume spike"), "DONCHIAN": ("donchian", "donchian channel", "price channel", "breakout"),
    "VOLATILITY": ("volatility", "vol", "standard deviation", "realized volatility", "realised volatility"),
    "CORRELATION": ("correlation", "corr"), "RANK": ("rank", "ranking", "percentile"), "VWAP": ("vwap", "volume weighted average price"),
}
INDICATOR_CALLS = {
    "RSI": ("rsi",), "MACD": ("macd",), "MOMENTUM": ("delta", "momentum"), "ROC": ("roc", "ref"), "SMA": ("mean", "sma", "ma"), "EMA": ("ema",),
    "BOLLINGER": ("bollinger",), "ATR": ("atr",), "STOCHASTIC_K": ("stochastic", "stochastic_k"), "WILLIAMS_R": ("williams_r",), "CCI": ("cci",),
    "VOLUME_RATIO": ("volume_ratio",), "DONCHIAN": ("donchian", "max", "min"), "VOLATILITY": ("std", "var"), "CORRELATION": ("corr",),
    "RANK": ("rank",), "VWAP": ("vwap",),
}


def alias_table(spark, aliases: dict[str, tuple[str, ...]], name: str = "alias") -> DataFrame:
    """(indicator, alias): one row per alias, in lower case with single spaces."""
    return spark.createDataFrame([(k, " ".join(a.lower().split())) for k, v in aliases.items() for a in v], f"indicator STRING, {name} STRING")


def word_runs(c: Column, longest: int) -> Column:
    """Distinct runs of 1 to ``longest`` neighbouring words of a text, lower case, joined by one space. Words are letters, digits and
    underscores; what lies between them does not count."""
    w = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"\w+"), F.lit(0))
    runs = lambda k: F.zip_with(w, F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1))), lambda _, i: F.when(i + k - 1 <= F.size(w), F.array_join(F.slice(w, i, F.lit(k)), " ")))
    return F.array_distinct(F.array_compact(F.concat(*[runs(k) for k in range(1, longest + 1)])))


def indicator_aliases(df: DataFrame, id_col: str, hypothesis: str = "hypothesis", text: str = "expr", aliases: dict | None = None, called: dict | None = None) -> DataFrame:
    """Indicators that a hypothesis names by any alias against those whose functions its expression calls.

    The word runs of a hypothesis meet the alias table in one equi join, so the work does not grow with the number of aliases; a text
    without words, or NULL, asks for nothing and has coverage 1. The alias tables are dictionaries of the caller, a few hundred rows.
    """
    aliases, called = aliases or INDICATOR_ALIASES, called or INDICATOR_CALLS
    longest = max(len(a.split()) for v in aliases.values() for a in v)
    spark = df.sparkSession
    runs = df.select(id_col, F.explode(word_runs(F.col(hypothesis), longest)).alias("alias"))
    names = F.array_distinct(F.transform(calls(F.coalesce(F.col(text), F.lit(""))), lambda x: x["name"]))
    uses = df.select(id_col, F.explode(names).alias("alias"))
    asked = runs.join(F.broadcast(alias_table(spark, aliases)), "alias").select(id_col, "indicator", F.lit(1).alias("_a"), F.lit(0).alias("_u"))
    used = uses.join(F.broadcast(alias_table(spark, called)), "alias").select(id_col, "indicator", F.lit(0).alias("_a"), F.lit(1).alias("_u"))
    every = df.select(id_col, F.lit(None).cast("string").alias("indicator"), F.lit(0).alias("_a"), F.lit(0).alias("_u"))
    met = asked.unionByName(used).unionByName(every).groupBy(id_col, "indicator").agg(F.max("_a").alias("_a"), F.max("_u").alias("_u"))
    both = F.count_if((F.col("_a") == 1) & (F.col("_u") == 1))
    wanted = F.count_if(F.col("_a") == 1)
    lacking = F.array_join(F.array_sort(F.collect_list(F.when((F.col("_a") == 1) & (F.col("_u") == 0), F.col("indicator")))), ",")
    return met.groupBy(id_col).agg(wanted.alias("requested"), both.alias("implemented"), lacking.alias("missing"),
                                   F.when(wanted > 0, both / wanted).otherwise(1.0).alias("coverage"))


def hash_id(*parts: Column, length: int = 12) -> Column:
    return F.substring(F.md5(F.lower(F.concat_ws(":", *parts))), 1, length)


def metric_lookup(m: Column, *names: str, default: float = 0.0) -> Column:
    """First present name in a map of metrics."""
    return F.coalesce(*[F.try_element_at(m, F.lit(n)) for n in names], F.lit(default))


def without_keys(m: Column, *names: str) -> Column:
    return F.map_filter(m, lambda k, _: ~k.isin(*names))
