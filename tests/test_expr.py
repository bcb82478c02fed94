"""Every operation of the expression language against Arrow kernels and literal values."""

import math

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import types as T

from millrace.functions import coalesce, col, if_else, lit
from millrace.functions.expr import lower

INTS = [7, -7, 0, 1, None, 2**40, -3]
FLOATS = [1.5, -7.5, 0.0, float("nan"), None, float("inf"), 2.5]


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, a, b, s, w) for i, (a, b, s, w) in enumerate(zip(INTS, FLOATS, [" a ", "B.c", "", None, "x$y", "aXa", " é\t"], [["p"], [], None, ["q", None], ["p", "q"], ["z"], [None]], strict=True))]
    return spark.createDataFrame(data, "i int, a long, b double, s string, w array<string>").orderBy("i")


def values(df, e):
    return [r[0] for r in df.select(lower(e, df.schema).alias("v"), "i").orderBy("i").collect()]


def same(x, y):
    if x is None or y is None:
        return x is y
    if isinstance(x, float) and math.isnan(x):
        return math.isnan(y)
    return x == y


def check(got, wanted):
    assert all(map(same, got, wanted)), (got, wanted)


A, B = pa.array(INTS, pa.int64()), pa.array(FLOATS, pa.float64())


@pytest.mark.parametrize("name, e, kernel", [
    ("add", col("a") + 2, lambda: pc.add(A, 2)),
    ("radd", 2 - col("a"), lambda: pc.subtract(2, A)),
    ("mul", col("b") * 2.0, lambda: pc.multiply(B, 2.0)),
    ("int_div", col("a") / 2, lambda: pc.divide(A, 2)),
    ("float_div", col("b") / 0.0, lambda: pc.divide(B, 0.0)),
    ("floordiv", col("b") // 2.0, lambda: pc.floor(pc.divide(B, 2.0))),
    ("int_floordiv", col("a") // 2, lambda: pc.cast(pc.divide(A, 2), pa.float64())),
    ("eq", col("b") == 1.5, lambda: pc.equal(B, 1.5)),
    ("ne", col("b") != col("b"), lambda: pc.not_equal(B, B)),
    ("lt", col("b") < 2.0, lambda: pc.less(B, 2.0)),
    ("ge", col("b") >= 0.0, lambda: pc.greater_equal(B, 0.0)),
    ("floor", col("b").floor(), lambda: pc.floor(B)),
    ("ceil", col("b").ceil(), lambda: pc.ceil(B)),
    ("abs", col("a").abs(), lambda: pc.abs(A)),
    ("and", (col("a") > 0) & (col("b") > 0.0), lambda: pc.and_kleene(pc.greater(A, 0), pc.greater(B, 0.0))),
    ("or", (col("a") > 0) | (col("b") > 0.0), lambda: pc.or_kleene(pc.greater(A, 0), pc.greater(B, 0.0))),
    ("not", ~(col("a") > 0), lambda: pc.invert(pc.greater(A, 0))),
    ("is_null", col("b").is_null(), lambda: pc.is_null(B)),
    ("fill_null", col("a").fill_null(9), lambda: pc.coalesce(A, 9)),
    ("if_else", if_else(col("a") > 0, 1, 2), lambda: pc.if_else(pc.greater(A, 0), 1, 2)),
])
def test_kernels(rows, name, e, kernel):
    check(values(rows, e), kernel().to_pylist())


def test_remainders(rows):
    check(values(rows, col("a") % 2), [1.0, -1.0, 0.0, 1.0, None, 0.0, -1.0])
    check(values(rows, col("b") % 2.0)[:3], [1.5, 0.5, 0.0])


def test_rounding_is_half_to_even(rows):
    check(values(rows, col("b").round())[:3], [2.0, -8.0, 0.0])
    assert values(rows, col("b").round())[6] == 2.0


def test_clip(rows):
    check(values(rows, col("b").clip(0.0, 2.0)), [1.5, 0.0, 0.0, 0.0, None, 2.0, 2.0])
    check(values(rows, col("b").clip(max=2.0))[3:4], [2.0])
    with pytest.raises(ValueError):
        col("b").clip()


def test_membership(rows):
    check(values(rows, col("a").is_in([7, 1])), [True, False, False, True, False, False, False])
    check(values(rows, col("a").is_in([7, None])), [True, False, False, False, True, False, False])
    check(values(rows, col("w").is_in(["p"])), [True, False, False, False, True, False, False])


def test_null_if(rows):
    check(values(rows, col("a").null_if(7)), [None, -7, 0, 1, None, 2**40, -3])
    check(values(rows, col("a").null_if(None)), [None] * 7)


def test_strings(rows):
    check(values(rows, col("s").str.strip()), ["a", "B.c", "", None, "x$y", "aXa", "é"])
    check(values(rows, col("s").str.upper())[1:2], ["B.C"])
    check(values(rows, col("s").str.len()), [3, 3, 0, None, 3, 3, 3])
    check(values(rows, col("s").str.replace(".", "-"))[1:2], ["B-c"])
    check(values(rows, col("s").str.regex_replace("(x)", r"$\1"))[4:5], ["$x$y"])
    check(values(rows, col("s").str.regex_contains("^a.a$"))[5:6], [True])


def test_types_must_agree(rows):
    for e in (col("a") == "x", col("s") + 1, col("a") & col("b"), ~col("a"), col("s").str.len() == "3", col("s").datetime.year()):
        with pytest.raises(TypeError):
            lower(e, rows.schema)
    with pytest.raises(KeyError):
        lower(col("nope"), rows.schema)


def test_trees():
    e = coalesce(col("x"), lit(1)) + col("y")
    assert e.columns() == ["x", "y"]
    assert e.to_dict()["op"] == "add"
    with pytest.raises(TypeError):
        bool(e)
    with pytest.raises(ValueError):
        col("__shard_id")


def test_pushdown(spark, tmp_path):
    spark.range(10).selectExpr("id", "id * 2 AS x", "cast(id AS string) AS s").write.parquet(str(tmp_path / "t"))
    from millrace.sources import read_parquet

    df = read_parquet(spark, str(tmp_path / "t"), columns=["id"], filter=(col("x") > 4) & col("s").is_not_null(), file_path_column=None).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,4)" in plan and df.columns == ["id"] and df.count() == 7


def test_dates(spark):
    df = spark.sql("SELECT 0 AS i, timestamp_ntz'2025-01-02 15:30:00' AS t")
    got = [values(df, getattr(col("t").datetime, f)())[0] for f in ("year", "month", "day", "hour")]
    assert got == [2025, 1, 2, 15] and str(values(df, col("t").datetime.to_date())[0]) == "2025-01-02"
    assert isinstance(df.select(lower(col("t").datetime.year(), df.schema)).schema[0].dataType, T.LongType)
