import datetime
import decimal
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from changelake.functions.lsn import format_lsn, parse_lsn
from changelake.functions.ordering import neighbour, running_total
from changelake.functions.partitioning import PartitionField, partition_by, write_partitioned
from changelake.functions.types import (
    can_be_unchanged, decode_binary, decode_text, field_type, source_type, spark_type, table_type, wider)


@pytest.mark.parametrize("oid, name", [
    (21, "int"), (23, "int"), (20, "long"), (700, "float"), (701, "double"), (1042, "string"),
    (1043, "string"), (25, "string"), (16, "boolean"), (1082, "date"), (1114, "timestamp"),
    (1184, "timestamptz"), (17, "binary"), (99999, "string"), (1700, "string")])
def test_table_type(oid, name):
    assert table_type(oid) == name


def test_spark_types():
    assert spark_type(1700, (10 << 16 | 2) + 4) == T.DecimalType(10, 2)
    assert spark_type(1700) == T.StringType()
    assert spark_type(21) == T.IntegerType()
    assert spark_type(1114) == T.TimestampNTZType()
    assert field_type("unsupported_type") == T.StringType()
    assert source_type(T.DecimalType(10, 2)) == "numeric"
    assert source_type(T.LongType()) == "int8"
    assert source_type(T.ArrayType(T.LongType())) == "text"
    assert can_be_unchanged(25) and can_be_unchanged(1700) and not can_be_unchanged(20)


def test_wider():
    assert wider(T.IntegerType(), T.LongType()) == T.LongType()
    assert wider(T.DoubleType(), T.FloatType()) == T.DoubleType()
    assert wider(T.DecimalType(10, 2), T.DecimalType(8, 4)) == T.DecimalType(12, 4)
    assert wider(T.IntegerType(), T.DateType()) == T.StringType()


@pytest.mark.parametrize("text, oid, value", [
    ("t", 16, True), ("f", 16, False), ("12", 23, 12), ("x12", 23, None), ("NaN", 701, "nan"),
    ("Infinity", 701, float("inf")), ("\\x0aff", 17, b"\x0a\xff"), ("0aff", 17, None),
    ("2024-01-02", 1082, datetime.date(2024, 1, 2)), ("infinity", 1082, None),
    ("2024-01-02 03:04:05.123456", 1114, datetime.datetime(2024, 1, 2, 3, 4, 5, 123456)),
    ("a  ", 1042, "a  "), ("{1,2}", 1007, "{1,2}")])
def test_decode_text(spark, text, oid, value):
    df = spark.createDataFrame([(text,)], "v STRING")
    found = df.select(decode_text(F.col("v"), spark_type(oid)).alias("x")).first().x
    found = bytes(found) if isinstance(found, bytearray) else found
    assert str(found) == "nan" if value == "nan" else found == value


def test_decode_zoned_numeric_and_binary(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05.5+02", "12.345", "C3A9", "FF")], "a STRING, b STRING, c STRING, d STRING")
    row = df.select(
        F.unix_micros(decode_text(F.col("a"), spark_type(1184))).alias("a"),
        decode_text(F.col("b"), spark_type(1700, (10 << 16 | 3) + 4)).alias("b"),
        decode_binary(F.col("c"), T.StringType()).alias("c"),
        decode_binary(F.col("d"), T.StringType()).alias("bad"),
        decode_binary(F.col("d"), T.BinaryType()).alias("d")).first()
    assert row.a == int(datetime.datetime(2024, 1, 2, 1, 4, 5, 500000, datetime.timezone.utc).timestamp() * 10**6)
    assert row.b == decimal.Decimal("12.345")
    assert row.c == "é" and row.bad is None and bytes(row.d) == b"\xff"


def test_lsn(spark):
    df = spark.createDataFrame([("16/B374D848",), ("7FFFFFFF/FFFFFFFF",), ("80000000/0",), ("x/1",), ("1",)], "t STRING")
    rows = df.select(parse_lsn("t").alias("l"), format_lsn(parse_lsn("t")).alias("t")).collect()
    assert [r.l for r in rows] == [97500059720, 2**63 - 1, None, None, None]
    assert rows[0].t == "16/B374D848" and rows[1].t == "7FFFFFFF/FFFFFFFF"


def _groups(spark):
    rng = random.Random(5)
    rows = [("hot", i, rng.randint(1, 9)) for i in range(3000)]
    rows += [(f"g{i % 40}", i, rng.randint(1, 9)) for i in range(400)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g STRING, o BIGINT, v BIGINT").repartition(4)


@pytest.mark.parametrize("hot", [10, 500, 10**6])
@pytest.mark.parametrize("step", [1, -1])
def test_neighbour_in_groups_of_any_size(spark, hot, step):
    rows, df = _groups(spark)
    expected, last = {}, {}
    for g, o, _ in sorted(rows, key=lambda r: (r[0], r[1] * -step)):
        expected[g, o] = last.get(g)
        last[g] = o
    found = neighbour(df, ["g"], ["o"], "o", "n", step, hot_rows=hot).collect()
    assert {(r.g, r.o): r.n for r in found} == expected and len(found) == len(rows)


@pytest.mark.parametrize("hot", [10, 500, 10**6])
def test_running_total_in_groups_of_any_size(spark, hot):
    rows, df = _groups(spark)
    expected, total = {}, {}
    for g, o, v in sorted(rows):
        total[g] = expected[g, o] = total.get(g, 0) + v
    found = running_total(df, ["g"], ["o"], F.col("v"), "n", hot_rows=hot).collect()
    assert {(r.g, r.o): r.n for r in found} == expected and len(found) == len(rows)


def test_partition_transforms(spark):
    df = spark.sql("select timestamp_ntz'2024-03-05 06:07:08' t, -7L v, 'abcdef' s")
    spec = [PartitionField("t", "year", "y"), PartitionField("t", "month", "m"), PartitionField("t", "day", "d"),
            PartitionField("v", "truncate", "w", 10), PartitionField("s", "truncate", "p", 3),
            PartitionField("v", "bucket", "b", 4)]
    row = partition_by(df, spec).first()
    assert (row.y, row.m, row.d) == (2024, datetime.date(2024, 3, 1), datetime.date(2024, 3, 5))
    assert (row.w, row.p) == (-10, "abc") and 0 <= row.b < 4
    with pytest.raises(ValueError):
        partition_by(df, [PartitionField("v", "other", "x")])


def test_write_partitioned(spark, tmp_path):
    df = spark.sql("select id, timestamp_ntz'2024-01-01' + make_dt_interval(cast(id as int)) t from range(100)")
    write_partitioned(df, [PartitionField("t", "month", "m")], str(tmp_path / "p"))
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == 100 and back.where("m = '2024-02-01'").count() == 29
