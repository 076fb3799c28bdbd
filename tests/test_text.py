"""Text and alignment against plain Python."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from phonolake.functions import align
from phonolake.functions import text as tx


def normal(text):
    """The stated rules, as plain Python."""
    text = text.casefold().replace("‌", "").replace("‍", "")
    text = re.sub(r"(?<=\d)[.,](?=\d)", "", text)
    return " ".join(re.sub(r"[^\w\sऀ-ॿ]", " ", text).split())


def distance(a, b):
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        cur = [i]
        for j, y in enumerate(b, 1):
            cur.append(min(cur[-1] + 1, prev[j] + 1, prev[j - 1] + (x != y)))
        prev = cur
    return prev[-1]


CASES = ["", "   ", "1,250.50", "1,2,3 a", "है। ठीक", "Straße ﬁn", "don't well-known", "a‌b‍c", "१,२३", "plan का call", "é é", "x_y 9", "A B", "काम" * 500]


def test_normalize(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*CASES, None])], "i int, t string").select("i", tx.normalize(F.col("t")).alias("n"), tx.words(F.col("t")).alias("w"), tx.characters(F.col("t")).alias("c")).orderBy("i").collect()
    for r, t in zip(rows, CASES, strict=False):
        assert r.n == normal(t)
        assert r.w == normal(t).split()
        assert r.c == [x for x in normal(t) if not x.isspace()]
    assert rows[-1].n is None and rows[-1].w is None


def test_strip_danda(spark):
    assert spark.range(1).select(tx.normalize(F.lit("है। ठीक"), strip_danda=True).alias("n")).first().n == "है ठीक"


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcdeकख"), max_size=9), st.lists(st.sampled_from("abcdeकख"), max_size=9)), min_size=1, max_size=20))
def test_distance(spark, pairs):
    df = spark.createDataFrame([(list(a), list(b)) for a, b in pairs], "a array<string>, b array<string>")
    got = df.select(align.token_distance(F.col("a"), F.col("b")).alias("x"), align.fold_distance(F.col("a"), F.col("b")).alias("y")).collect()
    for (a, b), r in zip(pairs, got, strict=True):
        assert r.x == r.y == distance(a, b)


def test_distance_of_many_tokens(spark):
    a, b = [f"w{i}" for i in range(2000)], [f"w{i}" for i in range(3, 2001)]
    df = spark.createDataFrame([(a, b)], "a array<string>, b array<string>")
    assert df.select(align.token_distance(F.col("a"), F.col("b")).alias("x")).first().x == distance(a, b)


@pytest.mark.parametrize("ref,hyp,wer", [("", "x", None), ("a b", "", 1.0), ("", "", None), ("a", "x y z", 3.0), ("a b c d", "a b d", 0.25)])
def test_metric(spark, ref, hyp, wer):
    m = spark.range(1).select(align.metric(align.counts(tx.normalize(F.lit(ref)), tx.normalize(F.lit(hyp)))).alias("m")).first().m
    assert m.wer == wer


def test_script_metrics(spark):
    m = spark.range(1).select(align.script_metrics(tx.normalize(F.lit("मेरा Plan active है")), tx.normalize(F.lit("मेरा प्लान active है"))).alias("m")).first().m
    assert m.is_code_mixed and m.english_word_accuracy == 0.5 and m.wrong_script_rate == 0.0 and m.wrong_script_words == 1
    assert m.latin_word_wer == 0.5 and m.devanagari_cer > 0


def test_nukta(spark):
    t = "क" + "़" + " ड" + "़" + " न" + "़" + " क़"
    got = spark.range(1).select(tx.fold_nukta(F.lit(t)).alias("x")).first().x
    assert got == "क ड न" + "़" + " क़"


def test_keywords_and_paths(spark):
    r = spark.range(1).select(
        tx.keyword_hits(F.lit("My REFUND for orders"), ["refund", "order", "x"]).alias("hits"), tx.stem(F.lit("a/b/c.tar.WAV")).alias("stem"), tx.suffix(F.lit("a/b/c.tar.WAV")).alias("suffix"),
        tx.parent(F.lit("a/b/c.wav")).alias("parent"), tx.line_id(F.lit(" id:: text")).alias("id"), tx.line_text(F.lit("id  two words ")).alias("text"), tx.line_text(F.lit("id")).alias("none"),
    ).first()
    assert r.hits == ["refund", "order"] and r.stem == "c.tar" and r.suffix == ".wav" and r.parent == "b" and r.id == "id" and r.text == "two words" and r.none is None
