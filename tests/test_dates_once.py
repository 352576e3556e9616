"""ISO texts: odd ones keep their day, and a row's text is searched once for all of its parts."""

import datetime
import re

import pytest
from pyspark.sql import functions as F

from skyloom.functions import calendar
from skyloom.plans import skies

TEXTS = {
    "2000-01-01": 2451544.5,
    "2000-01-01 12:00:30.25Z": 2451545.000350116,
    " \t2000-2-3T4:05  +0530 \n": 2451577.4409722225,
    "2000-13-40T99:99:99-05:30": 2451953.9240625,
    "2000-01-01T00:00+05:30 ": 2451544.2708333335,
    "+12345-06-07": 6230135.5,
    "-0000-00-00": 1721027.5,
    "99999999999999999999-01-01": 1721059.5,
    "2000-01-01-01:00": 2451544.5416666665,
    "2000-01-01T12": None,
    "2000-01-01T12:00:05Z+01:00": None,
    "2000,1,1,,,,,,": None,
    "999999999999999999": None,
    "١٢٣٤-01-01": None,
    "": None,
    None: None,
}


def test_odd_texts(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", calendar.parse_datetime(F.col("t")).alias("jd"))
    assert {r.t: r.jd for r in rows.collect()} == pytest.approx(TEXTS, abs=1e-9)


@pytest.mark.parametrize("read", [calendar.parse_datetime, calendar.jd_or_datetime])
def test_a_text_is_searched_once(spark, capsys, read):
    rows = spark.range(3).select(F.concat("id", F.lit("-01-01")).alias("t"))
    capsys.readouterr()
    rows.select(read(F.col("t"))).explain("codegen")
    code = capsys.readouterr().out
    assert code.count(".find()") + code.count(".find(0)") <= 2


def test_numbers_or_dates(spark):
    days = {"2451545.5": 2451545.5, " -12 ": -12.0, "1e5": 100000.0, "Infinity": float("inf"), "-0001-01-01": 1720694.5, "2000-01-01": 2451544.5, "x": None, "": None, None: None}
    rows = spark.createDataFrame([(t,) for t in days], "t string").select("t", calendar.jd_or_datetime(F.col("t")).alias("jd"))
    assert {r.t: r.jd for r in rows.collect()} == days


def test_the_query_stays_within_compiled_code(spark, tmp_path, capsys):
    """The JVM compiles no method of over 8000 bytes; and rows without a day, or that come twice, keep their texts."""
    day = datetime.datetime(2000, 1, 1, 7)
    spark.createDataFrame([(5, day), (5, day), (6, None), (None, day)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    rows = skies.dates_and_clocks(spark, str(tmp_path))
    capsys.readouterr()
    rows.explain("codegen")
    assert max(map(int, re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out))) < 8000
    none = ("null-null-null BCE", "null:null UTC", "null:null LMT")
    known = (5, 2451544.479167, "2000-01-01 CE", "05:00 UTC", "11:00 LMT")
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([known, known, (6, None, *none), (None, None, *none)], key=str)
