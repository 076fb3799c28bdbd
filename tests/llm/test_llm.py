"""Training-data operators against brute force, exact round trips and held-out rows, and their edge cases."""

import base64
import json
import random
import statistics
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phonolake.llm import canonical as p2
from phonolake.llm import garbled as p9
from phonolake.llm import language as p4
from phonolake.llm import packing as p8
from phonolake.llm import percentiles as p6
from phonolake.llm import pieces as p3
from phonolake.llm import queries as q
from phonolake.operators import ranks
from phonolake.llm import repetition as p5
from phonolake.llm import sentences as p1
from phonolake.llm import tokens as p7


@pytest.fixture(scope="module")
def samples(spark, folder):
    return q.samples(spark, folder)


@pytest.fixture(scope="module")
def splitter(samples):
    return p1.train(samples)


# ---- 1 sentences -----------------------------------------------------------------------------

WHOLE = [
    ["Dr. Joveth asked about it.", "She left at 5 p.m.", "Wait, what?!"],
    ["They offered vouchers, credit, etc.", "In the second part, we stopped."],
    ['She said, "It is broken. I want my money." and hung up.', 'She replied: "Who is calling?"', '"Where is it?" the man asked.'],
    ["1. Open take_4755.wav and listen.", "We lost .9 s at 9,446.57."],
    ["I was... um... waiting.", "Then it went silent...", "See sec. 3, fig. 11 of it."],
    ['क्या मंदिरा ने कहा, "रुको। फिर से बोलो!"?', "डॉ. ओजस ने रु. 12.5 भेजे।", "अरे... रुकिए... बात सुनिए।"],
    ["他说：“机器坏了。我要退钱。”然后就挂了电话。", "什么？！", "「什么时候能修好？」林知夏这样问。"],
    ["Sie sagte: „Es ist kaputt.“ und legte auf.", "Vgl. S. 13, Abb. 22 im Bericht."],
]


@pytest.mark.parametrize("parts", WHOLE)
def test_sentences(splitter, parts):
    glue = "" if ord(parts[0][0]) >= 0x2E80 else " "
    text = glue.join(parts)
    assert [text[a:b] for a, b in splitter.split(text)] == parts


def test_sentence_rules(splitter):
    say = lambda t: [t[a:b] for a, b in splitter.split(t)]
    assert say("Agent: no mark\nCaller: here") == ["Agent: no mark", "Caller: here"]
    assert say("บทเรียนนี้ ให้ดี") == ["บทเรียนนี้", "ให้ดี"]
    assert say("no mark at all") == ["no mark at all"] and say("  a b.  ") == ["a b."]
    assert say("") == say("  \n ") == say(None) == [] and len(say("One is here. " * 5000)) == 5000


def test_sentences_held_out(samples):
    """Trained on one half of the labelled sentences, most strings of the other half come apart right."""
    import re

    model, rng, right, n = p1.train(samples[::2]), random.Random(1), Counter(), Counter()
    by = {}
    for lang, t in samples[1::2]:
        by.setdefault(lang, []).append(t)
    for lang, rows in by.items():
        for _ in range(40):
            parts = rng.choices(rows, k=3)
            text = ("" if lang in ("zh", "ja") else " ").join(parts)
            if lang == "th":  # a blank between Thai letters ends a sentence
                parts = [p for part in parts for p in re.split(r"(?<=[\u0e01-\u0e3a\u0e40-\u0e4e]) (?=[\u0e01-\u0e3a\u0e40-\u0e4e])", part)]
            right[lang] += [text[a:b] for a, b in model.split(text)] == parts
            n[lang] += 1
    assert sum(right.values()) / sum(n.values()) > 0.95, right
    assert right["th"] == n["th"]


SHORTENED = [["Gen. Smith came."], ["Lt. Col. Rao spoke.", "Capt. Das left."], ["He works at Acme Corp.", "The office is big."], ["Dr. Rao came.", "She left."], ["We met Prof. Sen at 5 p.m.", "The call ended."]]


@pytest.mark.parametrize("parts", SHORTENED)
def test_shortenings_by_form(splitter, parts):
    text = " ".join(parts)
    assert [text[a:b] for a, b in splitter.split(text)] == parts


def test_gaps_without_marks(splitter):
    """Blanks between words and line breaks have posteriors too, by what the sentences say."""
    assert splitter.bare_end(("THAI", "THAI")) > 0.9 > 0.01 > splitter.bare_end(("l", "l")) and splitter.bare_end(("line", "line")) > 0.9
    assert all(splitter.bare_end((a, b)) < 0.5 for a in ("l", "U", "9", "CJK", "DEVANAGARI") for b in ("l", "U", "9", "CJK", "DEVANAGARI", "THAI"))
    text = "x" * 300 + ". " + "Y" * 300 + " and so on"
    assert splitter.split(text) == [(0, 301), (302, len(text))]


def test_posteriors_are_probabilities(splitter):
    p = splitter.posteriors(p1.gaps('He said: "No. Yes." Dr. A. came. Then\nit ended...'))
    assert p and all(0 <= x <= 1 for x in p)


def test_sentences_count_every_labelled_sentence(spark, folder, tmp_path):
    many_labelled(spark, folder, tmp_path)
    glued = lambda parts: ("" if ord(parts[0][0]) >= 0x2E80 else " ").join(parts)
    texts = dict(enumerate([*WHOLE, ["บทเรียนนี้", "ให้ดี"]]))
    spark.createDataFrame([(i, glued(parts)) for i, parts in texts.items()], "example_id bigint, reference string").write.parquet(f"{tmp_path}/examples.parquet")
    spark.createDataFrame([], "result_id bigint, hypothesis string").write.parquet(f"{tmp_path}/experiment_results.parquet")
    got = {}
    for r in q.p1_found(spark, str(tmp_path)).orderBy("row_id", "sent_no").collect():
        got.setdefault(r.row_id, []).append(glued(texts[r.row_id])[r.start_char : r.end_char])
    assert got == texts


def test_counts_of_buckets_add_up(spark, samples, splitter, monkeypatch):
    """One bucket gives the counts of a list; several give each sentence the same weight, whatever the partitions."""
    df = spark.createDataFrame(samples, "lang string, text string")
    one = p1.counted(df.union(df).union(spark.createDataFrame([("en", None), ("en", "")], "lang string, text string")))
    assert all(getattr(one, k) == getattr(splitter, k) for k in ("left", "right", "total", "bare", "known"))
    monkeypatch.setattr(p1, "BUCKET", 100)
    monkeypatch.setattr(p1, "_MODELS", {})
    many = p1.counted(df.repartition(7))
    p1._MODELS.clear()
    again = p1.counted(df.repartition(2))
    assert many.known == splitter.known and many.left != splitter.left and all(getattr(many, k) == getattr(again, k) for k in ("left", "right", "total", "bare"))
    assert sum(many.bare[()]) == pytest.approx(sum(splitter.bare[()]), rel=0.05)
    for parts in WHOLE:
        text = ("" if ord(parts[0][0]) >= 0x2E80 else " ").join(parts)
        assert [text[a:b] for a, b in many.split(text)] == parts


# ---- 2 consistent form -----------------------------------------------------------------------

FORMS = [
    ("fi‍g. ｖ４.６ a b", "fig. v4.6 a b"), ("Mаine Jiaganhaх", "Maine Jiaganhax"), ("cчёт", "счёт"), ("ﬁchier ℃ K", "fichier °C K"), ("é", "é"),
    ("كيا ہوئی", "کیا ہوئی"), ("अाप", "आप"), ("ทํา", "ทำ"), ("⾦", "金"), ("Ηumne", "Humne"), ("a­b​c⁠d﻿e", "abcde"), ("Est‑ce", "Est-ce"),
]
PLAIN = ["दुसर्‍या", "你好，什么？！（一）", "Д-р Агния: Что?", "the café’s “line” – 5 °C ½ © ™ …", "👩‍💻 ❤️", "ہم‌سفر", "क़ीमत", "", "  ", "ascii only"]


def test_forms():
    assert p2.canonical_array(pa.array([a for a, _ in FORMS])) == [b for _, b in FORMS]
    assert p2.canonical_array(pa.array(PLAIN)) == PLAIN
    assert p2.canonical_array(pa.array([None, "x"], pa.string())) == [None, "x"] and p2.canonical_array(pa.array([], pa.string())) == []


def test_form_is_stable_and_prefilter_whole():
    """A form's form is itself, and every changed text is one that the first look suspects."""
    import re

    rng = random.Random(3)
    pool = [a for a, _ in FORMS] + PLAIN
    texts = [" ".join(rng.choices(pool, k=4)) for _ in range(400)] + ["".join(rng.sample("".join(pool), 12)) for _ in range(400)]
    once = p2.canonical_array(pa.array(texts))
    assert p2.canonical_array(pa.array(once[:400])) == once[:400]
    table = pa.table({"i": range(len(texts)), "text": texts} | {f: pa.nulls(len(texts), pa.bool_()) for f in p2.FLAGS})
    full = p2.run_sql(p2.canonical_sql(where=False), table).sort_by("i").column("canon").to_pylist()
    assert once == full
    assert not re.search("[\u200b\u2060\u00ad\ufeff\u00a0\u2007]", "".join(once))


def test_letters_of_other_alphabets():
    """Greek and Arabic letters stay where they are usual, and change in words and texts of another alphabet."""
    same = ["α = 0.05", "αβγ", "Το σχολείο είναι εδώ", "λ and α", "كيف الحال يا صديقي", "ο Άγιος"]
    assert p2.canonical_array(pa.array(same)) == same
    assert p2.canonical_array(pa.array(["cαfé οld", "SΜS", "ο Μ", "يہ كيا ہے"])) == ["cafe\u0301 old".replace("e\u0301", "é"), "SMS", "o M", "یہ کیا ہے"]


def test_long_texts_and_large_batches():
    """2,000 texts of 20 KB and one of 20 MB, in slices; a long text has the form of its parts."""
    line = "Tarvimο का\u200b plan बंद है\u00a0- ｖ４ "
    many = pa.array([line * (20_000 // len(line.encode()))] * 2000)
    done = p2.canonical_array(many)
    assert len(set(done)) == 1 and "ο" not in done[0] and "\u200b" not in done[0] and "v4" in done[0]
    one = p2.canonical_array(pa.array([line * (20_000_000 // len(line.encode())), None, "x"]))
    assert one[0].startswith(done[0]) and one[1:] == [None, "x"] and one[0] == p2.canonical_array(pa.array([line]))[0] * (20_000_000 // len(line.encode()))


def test_parts_of_a_long_text(monkeypatch):
    rng = random.Random(11)
    pool = [a for a, _ in FORMS] + PLAIN
    texts = ["".join(rng.choices(pool, k=9)) for _ in range(8)] + [" ".join(rng.choices(pool, k=9)) for _ in range(8)]
    want = p2.canonical_array(pa.array(texts))
    monkeypatch.setattr(p2, "SLICE", 40)
    assert all("".join(p2.parts_of(t, 10)) == t for t in texts)
    assert p2.canonical_array(pa.array(texts)) == want


def test_found_rows(spark):
    df = spark.createDataFrame([(1, "a​b", "x"), (2, "ab", "y"), (3, None, "z"), (3, "ａ", "z")], "row_id int, text string, canon string")
    assert sorted(r.row_id for r in p2.canonical(df, ["row_id"], "text", only_changed=True, with_text=False).collect()) == [1, 3]
    assert sorted((r.row_id, r.canon) for r in p2.canonical(df.select("row_id", "text"), ["row_id"], "text").collect() if r.text) == [(1, "ab"), (2, "ab"), (3, "a")]


# ---- 3 pieces --------------------------------------------------------------------------------


def brute_pieces(x, limit=480, overlap=16, run=8, quiet=0.02):
    cuts, i = [], 0
    while i < len(x):
        j = i
        while j < len(x) and abs(x[j]) < quiet:
            j += 1
        if j - i >= run:
            cuts.append((i + j) // 2)
        i = max(j, i + 1)
    out, s = [], 0
    while len(x) - s > limit:
        fit = [c for c in cuts if s + overlap < c <= s + limit]
        e = fit[-1] if fit else s + limit
        out.append((s, e))
        s = e - overlap
    return [*out, (s, len(x))]


def test_pieces_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 4000))
        x = rng.uniform(-1, 1, n).astype(np.float32)
        for _ in range(int(rng.integers(0, 30))):
            a = int(rng.integers(0, n))
            x[a : a + int(rng.integers(1, 40))] = 0.001
        assert p3.cut(x) == brute_pieces(x)
    assert p3.cut(np.zeros(0)) == [] and p3.cut(np.zeros(3)) == [(0, 3)]


def envelope(rng, n):
    """A loudness envelope with pauses of several lengths, and as long stretches without one."""
    x = np.abs(rng.normal(0.4, 0.2, n)).clip(0.03, 1).astype(np.float32)
    at = 0
    while at < n:
        at += int(rng.integers(30, 250))
        x[at : at + int(rng.integers(4, 30))] *= 0.01
    return x


def test_landmarks_against_brute_force():
    rng = np.random.default_rng(3)
    x = envelope(rng, 600)
    x[5] = np.nan

    def hashed(window):
        h = 0
        for v in window:
            level = p3.LEVELS if v != v else int(np.clip(abs(v) * np.float32(p3.LEVELS), 0, p3.LEVELS))
            m = (level + 1) * int(p3.MULTIPLIER) % 2**64
            h = (h * 0x100000001B3 + (m ^ (m >> 31))) % 2**64
        return (h >> 20) % p3.DIVISOR

    want = [i for i in range(p3.WINDOW, len(x) + 1) if hashed(x[i - p3.WINDOW : i]) == 0]
    assert p3.landmarks(x).tolist() == want and len(want) > 2
    marks, natural = p3.landmarks(x), p3.boundaries(x)
    assert p3.snapped(marks, natural).tolist() == sorted({min(natural, key=lambda c: (abs(c - m), c)) for m in marks})
    assert p3.snapped(marks, natural[:0]).tolist() == marks.tolist()


def test_an_edit_alters_few_neighbours():
    """Insertions and deletions: pieces of the content-defined cuts meet again soon, those of the plain cuts later."""
    rng, altered, plain = np.random.default_rng(5), [], []
    for _ in range(300):
        x = envelope(rng, 9000)
        a, n = int(rng.integers(1000, 8000)), int(rng.integers(1, 60))
        y = np.concatenate([x[:a], envelope(rng, n), x[a:]]) if rng.random() < 0.5 else np.concatenate([x[:a], x[a + n :]])
        for out, how in ((altered, dict(divisor=p3.DIVISOR, least=p3.LEAST, last=False)), (plain, {})):
            one, other = ({z[s:e].tobytes() for s, e in p3.cut(z, **how)} for z in (x, y))
            out.append(len(other - one))
            assert all(0 < e - s <= p3.LIMIT for s, e in p3.cut(y, **how))
    assert np.mean(altered) < 2.5 and np.quantile(altered, 0.99) <= 8, (np.mean(altered), np.quantile(altered, 0.99))
    assert np.mean(altered) < np.mean(plain)
    print("altered pieces: mean, 99 per cent, most", [(np.mean(v), np.quantile(v, 0.99), max(v)) for v in (altered, plain)])


def test_pieces_table(spark):
    long = [0.5] * 1000
    df = spark.createDataFrame([(1, 0, "a", long), (1, 0, "b", long), (2, 0, "a", None), (3, 0, "a", []), (4, 0, "a", [0.1])], "f int, c int, piece_no string, audio array<float>")
    assert sorted(tuple(r) for r in p3.pieces(df, ["f", "c"], "audio", divisor=1, least=0, last=True).collect()) == [(1, 0, 0, 0, 480), (1, 0, 1, 464, 944), (1, 0, 2, 928, 1000)]
    assert p3.pieces(df.limit(0), ["f", "c"], "audio").count() == 0
    assert p3.pieces(df, ["f", "c"], "audio", all_items=True).count() == 4


# ---- 4 language ------------------------------------------------------------------------------


def test_language_held_out(samples):
    model = p4.fitted(samples[::2], 5)
    rest = samples[1::2]
    p = model.probabilities(p2.canonical_array(pa.array([t for _, t in rest])))
    right = [model.languages[k] == lang for k, (lang, _) in zip(p.argmax(axis=1), rest, strict=True)]
    assert sum(right) / len(right) > 0.93
    sure = p.max(axis=1) >= 0.8
    assert np.mean(np.array(right)[sure]) > 0.97


FOREIGN = [
    "Il pacco non è ancora arrivato e nessuno risponde al telefono.", "De vergadering van morgen is helaas afgezegd door ziekte.", "오늘 회의는 취소되었습니다. 내일 다시 연락드리겠습니다.",
    "Η συνάντηση ακυρώθηκε λόγω ασθένειας και θα γίνει αύριο.", "Mötet i morgon är tyvärr inställt på grund av sjukdom.",
]


def test_rejection(spark, samples):
    """Languages that the model doesn't know are rejected, and few held-out sentences of those it knows."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(FOREIGN)], "i int, t string")
    assert {r.lang for r in p4.segments(df, ["i"], "t", samples).collect()} == {"und"}
    assert "und" not in {r.lang for r in p4.segments(df, ["i"], "t", samples, reject=False).collect()}
    held = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(samples[1::2])], "i int, t string")
    got = [r.lang for r in p4.segments(held, ["i"], "t", samples[::2]).collect()]
    assert got.count("und") / len(got) < 0.1


def test_model_is_trained_once(samples, monkeypatch):
    first = p4.train(samples)
    monkeypatch.setattr(p4, "fitted", None)
    assert p4.train(samples) is first


def test_scripts_by_table():
    import re

    texts = ["", "abc", "Щи борщ", "नमस्ते", "你好ですアx", "สวัสดี", "\U0001f4de\U00020000", "اردو বাংলা தமிழ்"]
    assert p4.scripts_of(texts).tolist() == [[len(re.findall(b, t)) for b in p4.SCRIPTS.values()] for t in texts]


def test_rounds_are_fixed(samples, monkeypatch):
    """As many rounds however many labelled sentences there are."""
    made = np.random.default_rng
    rounds = []

    class Counted:
        def __init__(self, seed):
            self.own = made(seed)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def permutation(self, rows):
            rounds.append(len(rows))
            return self.own.permutation(rows)

    monkeypatch.setattr(np.random, "default_rng", Counted)
    p4.fitted(samples[::20], 5, [("en", f"call {chr(97 + k % 26)}") for k in range(8000)])
    assert len(rounds) == p4.EPOCHS and min(rounds) >= 8000


def test_labels(spark):
    rows = [("hi", "hi"), ("Hindi", "hi"), ("hin", "hi"), ("hi-IN", "hi"), (" EN ", "en"), ("zh-CN", "zh"), ("", ""), (None, ""), ("und", ""), ("auto", ""), ("-", ""), ("pt", "pt"), ("Español", "es")]
    got = spark.createDataFrame([(a,) for a, _ in rows], "l string").select(p4.label_language(F.col("l")).alias("x")).collect()
    assert [r.x for r in got] == [b for _, b in rows]


def test_segments(spark, samples):
    text = "मेरा प्लान अभी भी बंद है। आप लोग मेरी call काट देते हैं! Nobody from the office answered my call. Where is my parcel? 银行的短信一直没有处理好。"
    df = spark.createDataFrame([(1, text, "hi"), (2, "Nobody from the office answered.", "en"), (3, "Nobody from the office answered.", "fr"), (4, " ", None), (5, None, "en"), (6, "12 . 34", "en")], "i int, t string, lang string")
    got = {}
    for r in p4.mislabelled(df, ["i"], "t", "lang", samples).collect():
        got.setdefault(r.i, []).append((r.seg_no, r.lang))
    assert sorted(got[1]) == [(0, "hi"), (1, "en"), (2, "zh")] and got[3] == [(0, "en")] and 2 not in got and 4 not in got and 5 not in got
    every = {(r.i, r.seg_no): r for r in p4.segments(df, ["i"], "t", samples).collect()}
    assert every[6, 0].lang == "und" and every[6, 0].confidence == 0 and all(0 <= r.confidence <= 1 for r in every.values())
    assert text[every[1, 1].start_char : every[1, 1].end_char].startswith("Nobody")


# ---- 5 repetition ----------------------------------------------------------------------------


def brute_share(text, n=10):
    t = [c for c in (text or "").casefold() if p5.letters()[1][ord(c)]]
    seen, covered = set(), set()
    for i in range(len(t) - n + 1):
        g = tuple(t[i : i + n])
        if g in seen:
            covered |= set(range(i, i + n))
        seen.add(g)
    return len(covered) / len(t) if t else 0.0


def test_shares_against_brute_force():
    rng = random.Random(6)
    texts = ["", None, "...", "abc", "a" * 30, "Yes, YES! yes yes, yes"] + ["".join(rng.choice("abc .") for _ in range(rng.randint(0, 120))) for _ in range(150)]
    assert np.allclose(p5.Texts(texts).shares(), [brute_share(t) for t in texts])


def agreement(texts, model):
    """Recall and precision of the classifier alone against brute force."""
    want = np.array([brute_share(t) >= p5.SHARE for t in texts])
    got = p5.probability(p5.Texts(texts).features(), model) >= p5.LIKELY
    assert want.any() and not want.all()
    return (want & got).sum() / want.sum(), (want & got).sum() / got.sum()


def test_classifier_alone(samples):
    """Rows made anew, of many kinds and shares; held-out sentences."""
    model = p5.train([t for _, t in samples[::2]])
    rng = random.Random(9)
    texts = []
    for _ in range(600):
        parts = [rng.choice(samples[1::2])[1] for _ in range(rng.randint(1, 5))]
        texts.append(" ".join(parts + rng.choices(parts, k=rng.randint(0, 6))))
    assert min(agreement(texts, model)) > 0.99
    assert min(agreement(short_phrases(400, 3), model)) > 0.95
    p = p5.probability(p5.Texts(texts).features(), model)
    y = np.array([brute_share(t) >= p5.SHARE for t in texts])
    assert np.mean((p - y) ** 2) < 0.02  # calibrated


def test_rare_letters():
    """Letters of the last planes are told apart."""
    text = "".join(chr(0x30000 + k) for k in range(400))
    assert p5.Texts([text, text + text]).shares().tolist() == [0.0, 0.5]


def short_phrases(n, seed):
    """Texts in which a phrase of 10 to 15 letters returns between new words."""
    rng, out = random.Random(seed), []
    word = lambda k: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(k))
    for _ in range(n):
        phrase = f"{word(5)} {word(rng.randint(5, 10))}"
        out.append(" ".join(f"{word(rng.randint(2, 9))} {word(rng.randint(2, 9))} {phrase}" for _ in range(rng.randint(8, 40))))
    return out


def test_repetition_table(spark, samples):
    again = "say it again now " * 9
    df = spark.createDataFrame([("a", 1, again), ("a", 2, "one sentence only"), ("a", 3, None), ("b", 1, "ｓａｙ it​ again NOW, " * 9), ("a", 1, again)], "src string, row_id int, text string")
    known = [t for _, t in samples]
    assert sorted((r.src, r.row_id) for r in p5.repetition(df, ["src", "row_id"], "text", known, found=True).collect()) == [("a", 1), ("a", 1), ("b", 1)]
    got = p5.repetition(df, ["src", "row_id"], "text", known).collect()
    assert len(got) == 5 and {r.row_id for r in got if r.repeated_share > 0.8} == {1}


# ---- 6 percentiles ---------------------------------------------------------------------------


def test_percentiles_against_brute_force(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float("nan"), 1.5, rng.random() * 10, float(rng.randint(0, 5))]), f"2025-01-{rng.randint(1, 5):02d}") for _ in range(3000)] + [("one", 2.0, "2025-01-01"), ("none", None, "2025-01-01")]
    df = spark.createDataFrame(rows, "grp string, x double, d string").withColumn("t", F.to_timestamp("d")).repartition(7)
    want = {}
    for g in ("a", "b", None, "one"):
        v = sorted(x for h, x, _ in rows if h == g and x is not None and x == x)
        for p in p6.POINTS:
            at = p * (len(v) - 1)
            lo = int(at)
            want[g, p] = v[lo] + (v[min(lo + 1, len(v) - 1)] - v[lo]) * (at - lo)
    for s in (p6.states(df, "grp", ["x"]), p6.combine(p6.states(df, "grp", ["x"], "t"))):
        got = {(r.grp, r.percentile): r.value for r in p6.percentiles(s).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert statistics.median(x for h, x, _ in rows if h == "a" and x is not None and x == x) == pytest.approx(want["a", 0.5])
    assert p6.percentiles(p6.states(df.limit(0), "grp", ["x"])).count() == 0


def test_positions(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11).cast("int").alias("k"), F.hash("id").alias("v"))
    got = ranks.with_position(ranks.sorted_parts(df, ["k"], ["v"]), ["k"]).collect()
    by = {}
    for r in got:
        by.setdefault(r.k, []).append((r.position, r.v, r.total))
    assert len(got) == 5000 and all([p for p, _, _ in sorted(v)] == list(range(len(v))) and [x for _, x, _ in sorted(v)] == sorted(x for _, x, _ in v) and v[0][2] == len(v) for v in by.values())


# ---- 7 tokens --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def reference():
    tiktoken = pytest.importorskip("tiktoken")
    file = Path(p7.TOKENIZERS, f"{p7.NAME}.tiktoken")
    if not file.exists():
        pytest.skip("no tokenizers here")
    known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file.read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=p7.pattern(p7.TOKENIZERS), mergeable_ranks=known, special_tokens={})


def test_tokens_against_library(spark, folder, reference):
    e, rng = p7.encoder(p7.TOKENIZERS, p7.NAME), random.Random(5)
    letters = "abcdefghijklmnop eE01  éßक्ष中文\n\t'sAAaa"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a" * 3000, " " * 5000, "=-" * 3000, "<|endoftext|>", "", "中" * 999]
    texts += [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect() if r.text]
    assert e.encode(texts) == [reference.encode_ordinary(t) for t in texts]
    assert all(reference.decode(x) == t for x, t in zip(e.encode(texts), texts, strict=True))


def test_pair_test_is_exact(reference):
    """The vectorised test of a pair says the same as merging its bytes."""
    e, rng = p7.encoder(p7.TOKENIZERS, p7.NAME), random.Random(6)
    names = {r: t for t, r in e.made.items()}
    a, b = (np.array([rng.choice(list(names)) for _ in range(4000)]) for _ in range(2))
    assert e.compatible(a, b).tolist() == [e._merge(names[x] + names[y]) == [x, y] for x, y in zip(a, b, strict=True)]


def test_proposals_are_longest_matches(reference):
    e, rng = p7.encoder(p7.TOKENIZERS, p7.NAME), random.Random(7)
    longest = max(map(len, e.made))
    for _ in range(300):
        word = "".join(rng.choice("aetho éक中 =-") for _ in range(rng.randint(1, 40))).encode()
        want, at = [], 0
        while at < len(word):
            end = next(b for b in range(min(len(word), at + longest), at, -1) if word[at:b] in e.made)
            want.append(e.made[word[at:end]])
            at = end
        assert e._greedy(word) == want
    word = b"ab" * 300
    assert e._merge_long(word, 300) == [r for r in e._merge(word[:100], 300) for _ in "x"] * 6


def test_token_table(spark, reference):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id int, text string, ids string")
    assert [(r.doc_id, r.ids) for r in p7.token_ids(df).orderBy("doc_id").collect()] == [(1, []), (2, []), (3, reference.encode_ordinary("a b")), (3, reference.encode_ordinary("a b"))]
    assert p7.token_ids(df.limit(0), only_count=True).count() == 0


# ---- 8 packing -------------------------------------------------------------------------------


def test_plan_never_overfills():
    rng = random.Random(7)
    for capacity in (7, 50, 2048):
        for _ in range(20):
            counts = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 600)))
            places, opened = p8.plan(counts, capacity)
            fill = Counter()
            for size in counts:
                own = sorted(p[1:] for p in places if p[0] == size)
                for k, (rank, fit, first) in enumerate(own):
                    for r in range(rank, own[k + 1][0] if k + 1 < len(own) else counts[size]):
                        fill[first + (r - rank) // fit] += size
            assert set(fill) == set(range(opened)) and max(fill.values()) <= capacity and sum(fill.values()) == sum(s * n for s, n in counts.items())
            least = -(-sum(fill.values()) // capacity)
            assert opened <= least * 11 / 9 + 1


def test_capacity_is_bounded(spark):
    for capacity in (0, p8.SIZES + 1):
        with pytest.raises(ValueError, match="capacity"):
            p8.pack(spark.createDataFrame([(1, 2)], "doc_id int, n int"), "doc_id", "n", capacity)
    # the plan of the greatest capacity stays small
    rng = random.Random(3)
    places, opened = p8.plan(Counter(rng.randint(1, p8.SIZES) for _ in range(200_000)), p8.SIZES)
    assert len(places) < 3 * p8.SIZES and opened > 0


def test_pack(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([None, 0, 7, 7, rng.randint(1, 100), 250])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id int, n int")
    got = p8.pack(df.repartition(5), "doc_id", "n", 100).collect()
    fill, parts = Counter(), {}
    for r in got:
        fill[r.container_id] += r.size
        parts.setdefault(r.doc_id, []).append((r.piece_no, r.start, r.size))
    assert max(fill.values()) <= 100 and {i: sum(s for *_, s in p) for i, p in parts.items()} == {i: n for i, n in rows if n}
    assert all(len(p) == 1 for i, p in parts.items() if rows[i][1] <= 100) and sorted(parts[next(i for i, n in rows if n == 250)]) == [(0, 0, 100), (1, 100, 100), (2, 200, 50)]
    assert len(fill) <= 1.02 * sum(fill.values()) / 100 + 2 and p8.pack(df.limit(0), "doc_id", "n").count() == 0


# ---- 9 garbled text --------------------------------------------------------------------------


def read_as(text, codec):
    return "".join(p9.tables(codec)[0][b] for b in text.encode())


def test_garbled_round_trip(samples):
    """Every pair of UTF-8 with a wrong encoding on sentences that the counts don't know."""
    every = sorted({t for _, t in samples})
    known, held = tuple(every[::2]), every[1::2]
    texts = [t for t in held if not t.isascii() and sum(ord(c) > 127 for c in t) > 3]
    assert not [t for t in every if p9.is_garbled(t, known)]
    for codec in p9.WRONG:
        bad = [read_as(t, codec) for t in texts]
        assert sum(p9.is_garbled(t, known) for t in bad) / len(bad) > 0.98, codec
        back = [p9.restore(t, known)[0] == u for t, u in zip(bad, texts, strict=True)]
        assert sum(back) / len(back) > 0.98, codec
    twice = [read_as(read_as(t, "cp1252"), "cp1252") for t in texts]
    assert sum(p9.restore(t, known)[0] == u for t, u in zip(twice, texts, strict=True)) / len(texts) > 0.98
    four = read_as(read_as(read_as(read_as("été à côté", "cp1252"), "cp1252"), "cp1252"), "cp1252")
    assert p9.restore(four, known)[0] == "été à côté"


def test_restored_or_left(samples):
    """A restoration is right or isn't made."""
    known = tuple(sorted({t for _, t in samples}))
    right = [("año", "utf-8", "cp1253"), ("łódź", "utf-8", "cp852"), ("Où", "utf-8", "iso8859_2"), ("žluť", "utf-8", "cp1250"), ("naïve café", "cp1252", "mac_roman"), ("señor ¿qué?", "cp1252", "cp850"), ("Привет", "cp1251", "cp1252"), ("مرحبا بالعالم كيف الحال", "cp1256", "cp1252"), ("€5 – “hi”", "utf-8", "cp1252")]
    for text, true, wrong in right:
        assert p9.restore("".join(p9.tables(wrong)[0][b] for b in text.encode(true)), known)[0] == text, text
    for text, true, wrong in [("łódź", "cp852", "cp1252"), ("naïve café", "cp850", "cp1252")]:
        bad = "".join(p9.tables(wrong)[0][b] for b in text.encode(true))
        assert all(a in (b, c) for a, b, c in zip(p9.restore(bad, known)[0], bad, text, strict=True)), text
    good, n, whole = p9.restored(read_as("यह बिल्कुल सही", "cp1252").replace("\x8d", ""), known)
    assert n and not whole


def test_garbled_in_linear_time(samples):
    import time

    known = tuple(sorted({t for _, t in samples}))
    p9.restore(read_as(known[0] + "é", "cp1252"), known)
    rng = random.Random(4)
    text = read_as(" ".join("".join(rng.choice("абвгдежзиклмнопрсту") for _ in range(7)) for _ in range(10_000)), "cp1252")[:150_000]
    began = time.process_time()
    assert p9.is_garbled(text, known)
    assert time.process_time() - began < 1
    times = []
    for n in (40_000, 150_000):
        began = time.process_time()
        p9.restore(text[:n], known)
        times.append(time.process_time() - began)
    assert times[1] < 8 * max(times[0], 0.2), times
    began = time.process_time()
    p9.restore(("caf\u00c3\u00a9 \u0420\u0451" * 30_000)[:150_000], known)
    assert time.process_time() - began < 3


def test_only_matched_spans_change(samples):
    known = tuple(sorted({t for _, t in samples}))
    text = "Здесь всё верно. " + read_as("नीलपुर से", "cp1252") + " और यह सही है। «ÉTÉ» à côté…"
    assert p9.restore(text, known)[0] == "Здесь всё верно. नीलपुर से और यह सही है। «ÉTÉ» à côté…"
    assert p9.restore("caf�", known) == ("caf�", 0) and p9.is_garbled("caf�", known)
    for t in (None, "", "plain", "L'ÂGE À l'été, MAÇÃ VERDE ½ l – «Ñ»", "├── results\n│   └── a", "Рёбра «С» № 5"):
        assert not p9.is_garbled(t, known) and p9.restore(t, known) == (t, 0)


def test_legacy_by_rule(samples):
    """Short stretches of words that the labelled sentences don't have."""
    known = tuple(sorted({t for _, t in samples}))
    words = [("Щегольнём", c) for c in ("cp1251", "koi8_r", "cp866", "iso8859_5")] + [("مضبوط", "cp1256"), ("ช็อกโกแลต", "cp874"), ("ほうれんそう", "shift_jis"), ("ほうれんそう", "euc_jp"), ("萝卜蔬菜", "gbk")]
    for word, true in words:
        for wrong in ("cp1252", "latin-1", "cp437", "mac_roman", "koi8_r"):
            if wrong != true:
                bad = "On 12 May: " + "".join(p9.tables(wrong)[0][b] for b in word.encode(true)) + "."
                assert p9.is_garbled(bad, known), (word, true, wrong)
    for word, wrong in [("Щегольнём", "gbk"), ("Щегольнём", "shift_jis"), ("胡萝卜汤", "gbk"), ("胡萝卜汤", "shift_jis"), ("ヘリコプター", "gbk"), ("مضبوط", "gbk")]:
        assert p9.is_garbled(word.encode().decode(wrong), known), (word, wrong)
    assert p9.restore("Ùåãîëüí¸ì", known)[0] == "Щегольнём"
    for t in ("Щегольнём", "ЩЕГОЛЬНЁМ!", "Äöüß", "créée où", "ほうれんそう写些", "萝卜蔬菜", "╔════╗ ║ ░▒▓", "½¼¾ §§ ©®™", "مضبوط «ё»", "Δοκιμή", "Việt Nam được", "ÅÄÖ", "áéíóú"):
        assert not p9.is_garbled(t, known), t


def test_garbled_table(spark, samples):
    df = spark.createDataFrame([(1, read_as("café", "cp1252"), "x"), (2, "café", "x"), (3, None, "x"), (4, "a�", "x")], "doc_id int, text string, restored string")
    got = {r.doc_id: (r.restored, r.whole) for r in p9.garbled(df, [t for _, t in samples]).collect()}
    assert got == {1: ("café", True), 4: ("a�", False)}
    assert p9.garbled(df.limit(0), []).count() == 0


def many_labelled(spark, folder, place):
    """The labelled sentences behind more than two thousand others."""
    own = spark.read.parquet(f"{folder}/lang_samples.parquet")
    more = spark.range(1, 2101).selectExpr("id AS sample_id", "'en' AS lang", "concat('Line ', id, ' is here.') AS text")
    more.unionByName(own.withColumn("sample_id", F.col("sample_id") + 10_000)).write.parquet(f"{place}/lang_samples.parquet")


def test_garbled_counts_every_labelled_sentence(spark, folder, tmp_path):
    many_labelled(spark, folder, tmp_path)
    words = {1: ("съешь ещё", "koi8_r"), 2: ("ทดสอบ", "cp874")}
    rows = [(i, "".join(p9.tables("cp1252")[0][b] for b in w.encode(c))) for i, (w, c) in words.items()]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.restored for r in q.p9_restored(spark, str(tmp_path)).collect()} == {i: w for i, (w, _) in words.items()}
    labelled = spark.read.parquet(f"{tmp_path}/lang_samples.parquet")
    texts = {r.text for r in labelled.collect() if r.text}
    twice = labelled.select("text").union(labelled.select("text")).union(spark.createDataFrame([(None,), ("",)], "text string"))
    assert len(texts) > 2100 and p9.counted(twice.repartition(7), "text").grams == p9.grams_of(texts)


# ---- all -------------------------------------------------------------------------------------


def test_every_query_runs(spark, folder):
    for name, f in q.queries().items():
        df = f(spark, folder)
        assert df.count() > 0, name
        assert len(set(df.columns)) == len(df.columns)


def test_empty_tables(spark, folder, tmp_path):
    for t in ("examples", "experiment_results", "chunk_jobs", "transcription_results", "documents"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    spark.read.parquet(f"{folder}/lang_samples.parquet").write.parquet(f"{tmp_path}/lang_samples.parquet")
    for name, f in q.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_found_columns(spark, folder):
    want = {
        "p1_found": "src string, row_id bigint, sent_no int, start_char int, end_char int", "p2_found": "src string, row_id bigint", "p3_found": "file_index bigint, chunk_index int, piece_no int, start_sample int, end_sample int",
        "p4_found": "result_id bigint, seg_no int, lang string", "p5_found": "src string, row_id bigint", "p9_found": "doc_id bigint", "p7_ids": "doc_id bigint, ids array<int>",
    }
    for name, columns in want.items():
        assert ", ".join(f"{c} {t}" for c, t in q.queries()[name](spark, folder).dtypes) == columns
    assert json.dumps(sorted(want))
