import pandas as pd
import pytest

from factorspark.operators import fold_plan as fp
from factorspark.operators import folds as fo


def dates(n, key="a", start="2024-01-01"):
    return pd.DataFrame({"key": key, "ts": pd.date_range(start, periods=n)})


@pytest.mark.parametrize("scheme", ["sequential", "rolling", "walk", "purged", "forward"])
def test_plans_equal_the_fold_table_of_each_key(spark, scheme):
    """Keys of different length, down to one date; every date twice."""
    p = pd.concat([dates(n, k, s) for n, k, s in ((97, "a", "2024-01-01"), (41, "b", "2024-02-10"), (24, "c", "2024-03-01"), (5, "d", "2024-03-03"), (1, "e", "2024-03-03"))])
    d = spark.createDataFrame(p)
    got = {(r["key"], r["ts"], r["fold"], r["role"]) for r in fp.plans_by(d.unionAll(d), "key", scheme).collect()}
    want = set()
    for k in "abcde":
        want |= {(k, r["ts"], r["fold"], r["role"]) for r in fo.fold_table(fo.date_index(d.filter(f"key = '{k}'")), scheme).collect()}
    assert got == want


def test_fold_plan_in_sql(spark):
    d = spark.createDataFrame(pd.concat([dates(30), dates(30, None), dates(2, "b")]))
    d.unionByName(spark.createDataFrame([("b", None)], d.schema)).createOrReplaceTempView("plan_dates")
    fp.register_fold_plan(spark)
    rows = spark.sql("SELECT * FROM fold_plan(TABLE(plan_dates) PARTITION BY (key) ORDER BY (ts), 'sequential')").toPandas()
    assert len(rows) == 62 and rows["ts"].notna().all()
    assert rows[rows.key == "a"].role.value_counts().to_dict() == {"train": 18, "valid": 6, "test": 6}
    assert spark.sql("SELECT * FROM fold_plan(TABLE(SELECT * FROM plan_dates WHERE false) PARTITION BY (key) ORDER BY (ts), 'walk')").isEmpty()


def test_unknown_scheme():
    with pytest.raises(ValueError):
        list(fp.fold_ranges(10, "other"))
