"""Native text functions against Python's own."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.functions import text as T

ODD = "\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029 \t\u00a0\u3000a#:=b_9ж"


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=ODD, max_size=30), min_size=150, max_size=150))
def test_lines_strip_words(spark, texts):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    x = F.col("x")
    got = rows.select("i", T.splitlines(x).alias("lines"), T.strip(x).alias("bare"), T.words(x).alias("words"), T.is_blank(x).alias("blank")).collect()
    for r in got:
        want = texts[r.i]
        assert r.lines == want.splitlines()
        assert r.bare == want.strip()
        assert r.words == list(dict.fromkeys(want.lower().split()))
        assert r.blank == (not want.strip())


def test_tokens(spark):
    text = "foo_bar Baz9 9x été naïve straße мирЁж ٣٤"
    want = ["foo_bar", "baz9", "9", "x", "té", "naïve", "straße", "мирёж", "٣٤"]
    row = spark.createDataFrame([(text,)], "x string").select(T.tokenize(F.col("x")).alias("t")).first()
    assert row.t == want == re.findall(r"[a-zA-Z_]\w*|[а-яёА-ЯЁ]+|\d+", text.lower())


def test_suffix_and_duration(spark):
    from pathlib import PurePosixPath

    names = [".env", "a.tar.gz", "UP.PY", "x/y", "a/.hid/b.md", "..x", "trail.", "a.b/c", ".a.b"]
    rows = spark.createDataFrame([(x,) for x in names], "p string").select("p", T.suffix(F.col("p")).alias("s")).collect()
    for r in rows:
        want = PurePosixPath(r.p).suffix.lower()
        assert r.s == ("" if want == "." else want)
    took = spark.createDataFrame([(5.0,), (64.0,), (3720.0,), (None,), (-3.0,)], "s double").select(T.duration(F.col("s")).alias("d")).collect()
    assert [r.d for r in took] == ["5s", "1m 04s", "1h 02m", None, "0s"]
