import re
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from telemill.functions.timespan import UNIT_NANOS, format_timespan, is_timespan, parse_timespan

DAY = 86_400 * 10**9


def parse_all(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    out = df.select("i", parse_timespan(F.col("t")).alias("n"), is_timespan(F.col("t")).alias("ok")).orderBy("i").collect()
    assert all(r.ok == (r.n is not None) for r in out)
    return [r.n for r in out]


def expected(text):
    """Plain reading of the grammar, one text at a time."""
    m = re.fullmatch(r"(?:(\d+\.?\d*|\.\d+)d)?([+-]?)((?:0|(?:(?:\d+\.?\d*|\.\d+)(?:ns|us|µs|μs|ms|s|m|h))+)?)", text)
    if not m or not text or (m[2] and not m[3]):
        return None
    total = sum(
        int(Decimal(n if not n.startswith(".") else "0" + n) * UNIT_NANOS[u])
        for n, u in re.findall(r"(\d+\.?\d*|\.\d+)(ns|us|µs|μs|ms|s|m|h)", m[3])
    )
    days = int(Decimal(m[1]) * DAY) if m[1] else 0
    total = days + (-total if m[2] == "-" else total)
    return total if -(2**63) <= total < 2**63 else None


def test_known_texts(spark):
    known = {
        "1h10m10s": 4210 * 10**9, "7d": 7 * DAY, "1d12h": DAY + 12 * 3600 * 10**9, "2.5h": 9000 * 10**9, "0.5d": DAY // 2,
        "-90m": -5400 * 10**9, "1d-2h": 22 * 3600 * 10**9, "0": 0, "1d0": DAY, ".5h": 1800 * 10**9, "1.s": 10**9,
        "1h1h": 7200 * 10**9, "15ns": 15, "1.5us": 1500, "2µs": 2000, "2μs": 2000, "3ms": 3 * 10**6, "0.3ns": 0,
        "99999d": 99999 * DAY, "9223372036854775807ns": 2**63 - 1,
    }
    assert dict(zip(known, parse_all(spark, list(known)))) == known


def test_no_timespans(spark):
    texts = ["", " ", "2days", "-1d", "5", "1H", "d", ".d", "h", "1d1", "1h-5m", "+", "-", "1d+", "1 h", "1h\n", "1.2.3d",
             "9223372036854775808ns", "200000d", "1e3s", "٣h"]
    assert dict(zip(texts, parse_all(spark, texts))) == dict.fromkeys(texts)


def test_random_texts(spark):
    number = st.from_regex(r"\A(?:[0-9]{1,7}(?:\.[0-9]{0,5})?|\.[0-9]{1,4})\Z")
    unit = st.sampled_from(list(UNIT_NANOS))
    part = st.tuples(number, unit).map("".join)
    rest = st.tuples(st.sampled_from(["", "-", "+"]), st.lists(part, max_size=3).map("".join)).map("".join)
    days = st.one_of(st.just(""), number.map(lambda n: n + "d"))
    found = []

    @settings(max_examples=400, database=None, deadline=None)
    @given(st.tuples(days, rest).map("".join))
    def gather(text):
        found.append(text)

    gather()
    assert dict(zip(found, parse_all(spark, found))) == {t: expected(t) for t in found}


def test_format(spark):
    known = {
        0: "0s", 1: "1ns", 1100: "1.1µs", 2_200_000: "2.2ms", 3_300_000_000: "3.3s", 5_430 * 10**9: "1h30m30s",
        7 * DAY: "168h0m0s", 60 * 10**9: "1m0s", 245_001_000_000: "4m5.001s", 999_999_999: "999.999999ms",
        -(2**63): "-2562047h47m16.854775808s", 2**63 - 1: "2562047h47m16.854775807s", -1_500_000: "-1.5ms",
    }
    df = spark.createDataFrame([(n,) for n in [*known, None]], "n bigint")
    shown = {r.n: r.s for r in df.select("n", format_timespan(F.col("n")).alias("s")).collect()}
    assert shown == {**known, None: None}


def test_format_and_parse_are_inverse(spark):
    numbers = [0, 1, -1, 999, 1000, 10**9 - 1, 10**9 + 1, 3600 * 10**9, -(10**18) - 7, 2**63 - 1]
    df = spark.createDataFrame([(n,) for n in numbers], "n bigint")
    assert df.where(parse_timespan(format_timespan(F.col("n"))) != F.col("n")).count() == 0
