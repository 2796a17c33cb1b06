"""Order files: forms of time, line breaks in titles, and rows that cannot be read."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pannier.functions.scalar import parse_mixed, parse_timestamp
from pannier.sources import csv

HEADER = "created_at,profile_id,order_oms_id,order_item_oms_id,order_item_title,order_status_title\n"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2025-01-02T10:00", "10:00:00"),
        ("2025-01-02T10:00:05.123456789", "10:00:05"),
        ("2025-01-02T13:00:00+0300", "10:00:00"),
        ("2025-01-02 13:00:00+03:00", "10:00:00"),
        ("2025-01-02T10:00Z", "10:00:00"),
        ("20250102", "00:00:00"),
        ("20250102100000", "10:00:00"),
        ("2025/01/02 10:00", "10:00:00"),
        ("2025-1-2 9:05", "09:05:00"),
        ("2025-1-2 9:05:01.5", "09:05:01"),
        ("01/02/2025", "00:00:00"),
        ("1/2/2025 3:04 PM", "15:04:00"),
        ("1/2/2025 12:04:05 am", "00:04:05"),
        ("Jan 2, 2025", "00:00:00"),
        ("january 2 2025 10:00", "10:00:00"),
        ("2 Jan 2025 10:00:07", "10:00:07"),
        (" 2.1.2025  10:00 ", "10:00:00"),
    ],
)
def test_written_forms(spark, text, want):
    got = spark.createDataFrame([(text,)], "t string").select(
        F.date_format(parse_mixed(F.col("t")), "yyyy-MM-dd HH:mm:ss")
    )
    assert got.first()[0] == f"2025-01-02 {want}"


def test_line_break_in_a_title(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(HEADER + '2025-01-02,1,7,3,"two\nlines, ""q""",F\n2025-01-03,,8,4,plain,F\n')
    rows = csv.read_order_lines(spark, str(path)).orderBy("order_id").collect()
    assert [(r["order_id"], r["item_id"], r["title"]) for r in rows] == [(7, 3, 'two\nlines, "q"'), (8, 4, "plain")]


@pytest.mark.parametrize("row", ["soon,1,7,3,t,F", "2025-01-02,1,x7,3,t,F", "2025-01-02,1,7,x3,t,F", "2025-01-02,1,7.5,3,t,F", "2025-01-02,p,7,3,t,F", "2025-01-02,1.5,7,3,t,F"])
def test_a_row_that_cannot_be_read_stops_the_job(spark, tmp_path, row):
    path = tmp_path / "bad.csv"
    path.write_text(HEADER + row + "\n")
    with pytest.raises(Exception, match="cannot be read"):
        csv.read_order_lines(spark, str(path)).collect()


def test_forms_that_are_no_time(spark):
    rows = [("soon",), ("2025-13-40",), ("32.01.2025",), ("13/13/2025",), ("Foo 2, 2025",), ("2025",), ("",), (None,), ("2025-01-02 25:00",)]
    got = spark.createDataFrame(rows, "t string").select(parse_mixed(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in got] == [None] * len(rows)
    day_first = spark.createDataFrame([("25/12/2024 8:00",)], "t string").select(F.date_format(parse_mixed(F.col("t")), "yyyy-MM-dd HH:mm"))
    assert day_first.first()[0] == "2024-12-25 08:00"
    given = spark.createDataFrame([("02_01_2025",)], "t string").select(F.date_format(parse_timestamp(F.col("t"), ["dd_MM_yyyy"]), "yyyy-MM-dd"))
    assert given.first()[0] == "2025-01-02"


def test_rejected_lines_are_counted_and_left_out(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    path.write_text(
        HEADER + "soon,1,7,3,t,F\n2025-01-02,1.5,7,x3,t,F\n2025-01-02,,8.0,4,t,F\nsoon,1,9,5,t,F\n,2,10,,t,F\n"
    )
    kept = csv.read_order_lines(spark, str(path), rejects=True).collect()
    assert sorted((r["order_id"], r["item_id"], r["profile_id"]) for r in kept if r["item_id"]) == [(8, 4, None)]
    assert {r["order_id"] for r in kept} == {8, 10}
    counts = csv.reject_counts(csv.rejected_order_lines(spark, str(path))).collect()
    assert {(r["column"], r["value"]): r["n"] for r in counts} == {
        ("created_at", "soon"): 2, ("profile_id", "1.5"): 1, ("order_item_oms_id", "x3"): 1,
    }


def test_lines_and_rejects_are_counted_in_one_reading(spark, tmp_path):
    path = tmp_path / "mixed.csv"
    rows = "soon,1,7,3,t,F\n2025-01-02,1.5,7,x3,t,F\n2025-01-02,,8.0,4,t,F\nsoon,1,9,5,t,F\n,2,10,,t,F\n,2,,4,t,F\n"
    path.write_text(HEADER + rows)
    counts = csv.line_counts(spark, str(path))
    assert {(r["column"], r["value"]): r["n"] for r in counts.collect()} == {
        ("created_at", "soon"): 2, ("profile_id", "1.5"): 1, ("order_item_oms_id", "x3"): 1, ("kept", ""): 2,
    }
    assert counts._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    path.write_text(HEADER + "soon,1,7,3,t,F\n")
    assert {(r["column"], r["n"]) for r in csv.line_counts(spark, str(path)).collect()} == {("created_at", 1), ("kept", 0)}
