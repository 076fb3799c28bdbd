"""Signals, chunks and merging against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.functions import signal as sg
from phonolake.operators import merging


def one(spark, a, f):
    df = spark.createDataFrame([(a,)], "a array<double>")
    return df.select(f(F.col("a")).alias("x")).first().x


@pytest.mark.parametrize("n,rate,target", [(64, 64, 48), (10, 16000, 8000), (7, 8000, 16000), (1, 16000, 8000), (5, 3, 3)])
def test_resample(spark, n, rate, target):
    a = np.random.default_rng(1).normal(size=n)
    m = n if rate == target else max(1, round(n * target / rate))
    want = np.interp(np.linspace(0, 1, m, endpoint=False), np.linspace(0, 1, n, endpoint=False), a)
    assert np.allclose(one(spark, a.tolist(), lambda c: sg.resample(c, rate, target)), want)


def test_resample_empty(spark):
    assert one(spark, [], lambda c: sg.resample(c, 2, 1)) == [] and one(spark, None, lambda c: sg.resample(c, 2, 1)) is None


def test_mulaw(spark):
    a = [-1.0, -0.3, 0.0, 0.01, 0.7]
    assert np.allclose(one(spark, a, sg.companded), a)
    assert np.allclose(one(spark, [-1.0, 0.5, 0.999, 1.0], sg.quantized), [-1.0, 0.5, 127 / 128, 127 / 128])


def test_telephony_is_repeatable(spark):
    a = np.sin(np.arange(40)).tolist()
    df = spark.createDataFrame([(a,)], "a array<double>")
    x, y = (sg.telephony(df, "a", 16000, F.lit(3)).first().telephony for _ in range(2))
    assert x == y and len(x) == 40 and max(map(abs, x)) <= 1


def test_polyphase_keeps_a_level(spark):
    x = one(spark, [1.0] * 400, lambda c: sg.polyphase(48, 32)(c))
    assert len(x) == 267 and np.allclose(x[40:-40], 1, atol=0.02)


def windows(n, size, overlap):
    if n <= size:
        return [(0, n)]
    out, start = [], 0
    while start < n:
        end = min(start + size, n)
        out.append((start, end))
        if end >= n:
            break
        start += size - overlap
    return out


@pytest.mark.parametrize("n", [0, 1, 9, 10, 11, 12, 17, 18, 19, 26, 40])
def test_overlapped(spark, n):
    got = one(spark, [float(i) for i in range(n)], lambda c: sg.overlapped(c, 10, 2))
    assert [(r.start, r.stop) for r in got] == windows(n, 10, 2)
    assert [len(r.chunk) for r in got] == [b - a for a, b in windows(n, 10, 2)]


def test_overlap_bounds():
    with pytest.raises(ValueError):
        sg.overlapped(F.lit(1), 10, 10)


@pytest.mark.parametrize("n", [1, 44, 45, 46, 90, 91])
def test_tumbling(spark, n):
    assert [len(r.chunk) for r in one(spark, [0.0] * n, lambda c: sg.tumbling(c, 45))] == [min(45, n - s) for s in range(0, n, 45)]


def test_tumbling_empty(spark):
    assert one(spark, [], lambda c: sg.tumbling(c, 45)) is None


@pytest.mark.parametrize("n", [0, 3, 14, 15, 33, 34, 35, 46, 47, 64])
def test_streamed(spark, n):
    a = [float(i + 1) for i in range(n)]
    want, start, frame = [(a + [0.0] * 16)[:16]], 4 * 4 - 2, 4
    while start < n:
        want.append((a[start : start + 20] + [0.0] * 20)[:20])
        if start + 20 >= n:
            break
        frame += 3
        start = frame * 4 - 2
    assert [r.chunk for r in one(spark, a, lambda c: sg.streamed(c, 16, 20, 4, 4, 4, 3))] == want


def test_channels(spark):
    df = spark.createDataFrame([([[1.0, 3.0], [2.0, 4.0]],), ([],), (None,)], "f array<array<double>>")
    rows = df.select(sg.channel(F.col("f"), "left").alias("l"), sg.channel(F.col("f"), "right").alias("r"), sg.channel(F.col("f"), "average").alias("m")).collect()
    assert rows[0].l == [1.0, 2.0] and rows[0].r == [3.0, 4.0] and rows[0].m == [2.0, 3.0] and rows[1].l == [] and rows[2].l == []
    with pytest.raises(Exception, match="single-channel"):
        spark.createDataFrame([([[1.0]],)], "f array<array<double>>").select(sg.channel(F.col("f"), "right")).collect()


def test_spans(spark):
    assert [(r.start, r.end) for r in one(spark, [0.5, 0.0, 0.3, 0.3, 0.0, 0.2], lambda c: sg.speech_spans(c, 0.1))] == [(0, 1), (2, 4), (5, 6)]


@pytest.mark.parametrize("a,b,want", [("a b c", "b c d", "a b c d"), ("", "x", "x"), ("x", None, "x"), ("a b", "a b", "a b"), ("a", "b", "a b"), ("a b", "b", "a b"), ("x a a", "a a a", "x a a a")])
def test_merge(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(merging.merge(F.col("a"), F.col("b")).alias("m")).first().m == want


def test_merge_limit(spark):
    words = [f"w{i}" for i in range(20)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[5:] + ["z"]))], "a string, b string")
    assert df.select(merging.merge(F.col("a"), F.col("b")).alias("m")).first().m == " ".join(words + words[5:] + ["z"])


def test_fold(spark):
    df = spark.createDataFrame([("f", 2, "c d"), ("f", 0, "a b"), ("f", 1, "b c"), ("g", 0, None)], "file string, i int, t string")
    assert {r.file: (r.text, r.n_chunks) for r in merging.fold(df, "file", "i", "t").collect()} == {"f": ("a b c d", 3), "g": ("", 1)}
