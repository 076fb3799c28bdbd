"""Manifest matching, segments, reports, sources, sinks, models and streams on small tables."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from phonolake.functions import models
from phonolake.functions import structured as st
from phonolake.operators import manifest, report, segments
from phonolake.sources import audio, parameters, sinks, texts
from phonolake.streaming import turns


def matches(identifier, c):
    return identifier == c or (c.endswith("_") and identifier.startswith(c)) or identifier.startswith(c + "_") or f"_{c}_" in identifier


def test_identifier_parts(spark):
    """The parts are exactly the candidates that the rules match."""
    rng = random.Random(4)
    ids = ["".join(rng.choice("ab_") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    wanted = ["".join(rng.choice("ab_") for _ in range(rng.randint(1, 4))) for _ in range(60)]
    got = {r.i: set(r.p) for r in spark.createDataFrame([(i,) for i in set(ids)], "i string").select("i", manifest.identifier_parts(F.col("i")).alias("p")).collect()}
    for i in ids:
        for c in wanted:
            assert (c in got[i]) == matches(i, c), (i, c)


LINES = ["# made by hand", "d/one.wav\tclip", "d/one.wav\tlong_", "", "long_1: first part", "two second words", "long_2 next part", "x_two_y third", "alone", "three:glued words here", "four: "]


def lines(spark):
    return spark.createDataFrame(list(enumerate(LINES)), "line_no bigint, value string")


def test_match(spark):
    files = spark.createDataFrame([(f"d/{n}.wav",) for n in ("one", "two", "three", "four", "five", "one")] + [(None,)], "audio string").filter("audio is not null")
    known = manifest.mappings(lines(spark))
    assert [tuple(r) for r in known.collect()] == [("d/one.wav", "long_")]
    got = {r.audio: (r.reference, r.n_segments) for r in manifest.match(files, texts.ground_truth(lines(spark)), known).collect()}
    assert got == {"d/one.wav": ("first part next part", 2), "d/two.wav": ("second words third", 2), "d/three.wav": ("three:glued words here", 0), "d/four.wav": ("four:", 0)}


def test_transcripts(spark):
    df = spark.createDataFrame([(0, "a.txt one"), (1, "b"), (2, "a.wav  two words"), (3, "")], "line_no bigint, value string")
    assert [tuple(r) for r in manifest.transcripts(df).collect()] == [("a", "two words")]


def test_speakers(spark):
    t = spark.createDataFrame([("c", 0, "B", 0.0, 1.0), ("c", 1, "A", 1.0, 2.0), ("c", 2, "A", 3.0, 2.0)], "clip string, seg_idx int, speaker string, start double, end double")
    assert segments.longest_speaker(segments.speaker_totals(t)).first().speaker == "B"
    d = spark.range(1).select(F.create_map(F.lit("x"), F.lit(1.0), F.lit("y"), F.lit(1.0)).alias("m"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")).alias("e"))
    r = d.select(segments.choose_speaker(F.col("m")).alias("a"), segments.choose_speaker(F.col("e")).alias("b"), segments.choose_speaker(F.col("m"), "y").alias("c")).first()
    assert (r.a, r.b, r.c) == ("x", None, "y")
    with pytest.raises(Exception, match="not found"):
        d.select(segments.choose_speaker(F.col("m"), "z")).collect()


def test_islands(spark):
    df = spark.createDataFrame([("k", s, e) for s, e in [(0.0, 1.0), (1.2, 2.0), (5.0, 5.1), (6.0, 8.0), (7.0, 7.5)]] + [("k", None, 1.0)], "k string, s double, e double")
    got = sorted((round(r.start, 2), round(r.end, 2), r.n) for r in segments.islands(df, "k", F.col("s"), F.col("e"), 0.5, 0.5, 0.1).collect())
    assert got == [(-0.1, 2.1, 2), (5.9, 8.1, 2)]


def test_turn_rules(spark):
    r = spark.range(1).select(
        segments.turn_finished(segments.trailing_silence(F.lit(2.0), F.lit(1.2)), F.lit(True)).alias("a"), segments.turn_finished(F.lit(0.1), F.lit(False)).alias("b"),
        segments.unsure(F.lit(-0.8), F.lit(0.6)).alias("c"), segments.unsure(F.lit(-0.801)).alias("d"), segments.trailing_silence(F.lit(2.0), F.lit(None).cast("double")).alias("e"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == (True, True, False, True, 2.0)
    assert tuple(spark.createDataFrame([], "p double, s double").agg(*segments.confidence(F.col("p"), F.col("s"))).first()) == (-99.0, 1.0)


def test_rates_of_nothing(spark):
    df = spark.createDataFrame([("a", "", "x"), ("b", "one two", None), ("b", None, "x")], "g string, reference string, hypothesis string")
    got = {r.g: r for r in report.corpus_rates(report.scored(df), "g").collect()}
    assert got["a"].wer is None and got["b"].wer == 1.0 and got["b"].n == 1


def test_published_pooled_rates():
    """Pooled word error rates from errors and words of two clips."""
    assert [round(100 * (a + b) / (22 + 24), 2) for a, b in ((13, 5), (17, 27), (16, 23))] == [39.13, 95.65, 84.78]


def test_index_and_batches(spark):
    df = spark.range(101).withColumn("k", F.hash("id"))
    order = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: r.k))}
    assert all(r.idx == order[r.id] and r.batch_id == r.idx // 7 for r in report.batches(df, 7, "k").collect())
    assert report.with_index(spark.createDataFrame([], "k int"), "k").count() == 0


def test_answers(spark):
    df = spark.createDataFrame([('{"cleaned_transcript":"t","intent":"refund_issue","entities":{"amount":"5"},"requires_confirmation":false}',), ('{"intent":null}',), ("not json",), (None,)], "j string")
    a = [r.a for r in df.select(st.parse_answer(F.col("j"), F.lit("raw"), F.lit(True)).alias("a")).collect()]
    assert (a[0].cleaned_transcript, a[0].intent, a[0].entities.amount, a[0].requires_confirmation) == ("t", "refund_issue", "5", False)
    assert all((x.cleaned_transcript, x.intent, x.requires_confirmation) == ("raw", "unknown", True) for x in a[1:])


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    x = np.sin(np.arange(50)) * 0.5
    (tmp_path / "in/A.WAV").write_bytes(sinks.encode_wave(x, 16000))
    (tmp_path / "in/sub/b.mp3").write_bytes(b"no sound")
    (tmp_path / "in/c.txt").write_bytes(b"")
    assert audio.paths(spark, str(tmp_path / "in")).count() == 2 and audio.paths(spark, str(tmp_path / "in"), recursive=False).count() == 1
    rows = {r.path[-5:]: r for r in audio.decoded(audio.files(spark, str(tmp_path / "in"))).collect()}
    assert np.allclose(rows["A.WAV"].samples, x, atol=1e-4) and rows["b.mp3"].samples is None and rows["b.mp3"].error
    assert len(audio.decoded(audio.files(spark, str(tmp_path / "in"), False), keep_channels=True).first().samples[0]) == 1

    df = spark.createDataFrame([("a\nb", 'say "x"', "é", None), (None, "", "y", 1.0)], "one string, two string, three string, four double")
    sinks.csv(df, str(tmp_path / "csv"))
    assert {r.three: r.one for r in texts.results(spark, str(tmp_path / "csv")).collect()}["é"] == "a\nb"
    sinks.json_lines(df, str(tmp_path / "json"))
    assert any("é" in p.read_text() for p in (tmp_path / "json").glob("*.json"))
    written = sinks.waves(spark.createDataFrame([("w", [0.1, 0.2], 8000)], "n string, a array<double>, r int"), str(tmp_path / "waves"), sinks.batch_names("x", F.lit(7)), "a", "r")
    assert written == 1 and (tmp_path / "waves/x_00007.wav").exists()

    (tmp_path / "gt.txt").write_text("# c\n\n a\tb \nid: text\n")
    assert [r.value for r in texts.ground_truth(texts.lines(spark, str(tmp_path / "gt.txt"))).orderBy("line_no").collect()] == ["# c", "a\tb", "id: text"]
    (tmp_path / "m.json").write_text(json.dumps([{"audio": "x.wav", "text": "hi"}]))
    assert texts.manifest(spark, str(tmp_path / "m.json")).first().reference == "hi"
    (tmp_path / "cases.json").write_text(json.dumps({"test_cases": [{"sample_id": "s", "boost_keywords": ["a"]}]}))
    assert texts.cases(spark, str(tmp_path / "cases.json")).first().paralinguistic_tags is None


def test_documents(spark):
    rates = spark.createDataFrame([("clean", 2, 0.5), ("empty", 0, None)], "slice string, n bigint, wer double")
    records = spark.createDataFrame([("clean", "a"), ("clean", "b")], "slice string, audio string")
    doc = json.loads(sinks.evaluation(records, rates, {"model": "m"}).first().value)
    assert doc["model"] == "m" and doc["slices"]["clean"]["count"] == 2 and len(doc["slices"]["clean"]["records"]) == 2 and doc["slices"]["empty"]["records"] == []
    out = json.loads(sinks.results_document(spark.createDataFrame([("b", None), ("a", 1.0)], "stage string, wer double"), "stage").first().value)
    assert out == {"results": [{"stage": "a", "wer": 1.0}, {"stage": "b", "wer": None}]}
    assert "N/A" in sinks.console(spark.createDataFrame([("raw", None, 0.1, 0.2)], "stage string, wer double, cer double, rtf_total double")).first().row


def test_parameters():
    assert parameters.parse(["--chunk-seconds", "10", "--overlap-seconds", "1", "--evaluate"]).chunk_samples == 160000
    for bad in (["--overlap-seconds", "30"], ["--batch-size", "0"], ["--lookahead-tokens", "5"], ["--vad-threshold", "2"]):
        with pytest.raises(ValueError):
            parameters.parse(bad)
    with pytest.raises(ValueError):
        parameters.supported_rate(44100)


def test_models(spark):
    class Picky(models.Stub):
        def transcribe(self, batch, rate):
            if any(x[0] > 5 for x in batch):
                raise ValueError("loud")
            return super().transcribe(batch, rate)

    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [9.0]), (3, []), (4, None), (5, [0.5])], "i int, a array<float>")
    got = {r.i: r for r in models.transcribed(df, ["i"], "a", 16, Picky, 5).collect()}
    assert got[1].hypothesis and got[5].hypothesis and "loud" in got[2].error and got[3].hypothesis == got[4].hypothesis == ""
    assert models.hypothesis_text([["  x "]]) == "x" and models.hypothesis_text(None) == "" and models.hypothesis_text(7) == "7"


@pytest.mark.parametrize("text,lang,want", [("twenty five rupees", "en", "25 rupees"), ("two thousand three hundred", "en", "2300"), ("nine eight seven", "en", "987"), ("पाँच सौ रुपये", "hi", "500 रुपये"), ("", "en", ""), (None, "en", None)])
def test_spoken_numbers(text, lang, want):
    assert models.spoken_to_digits(text, lang) == want


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0), (1, 0.5), (1, 2.0), (2, 0.1), (9, 100.0)], "user int, s double").withColumn("t", F.timestamp_seconds("s"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = turns.store(turns.turns(stream, "user", "t"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert q.awaitTermination(120)
    done = {(r.user, r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {(1, 2), (1, 1), (2, 1)} <= done


def test_queries_run(spark, folder):
    """Every query runs on the smallest tables and keeps its columns on empty ones."""
    import __spark_entry__ as e

    for name in ("a01_corpus_rates", "j01_manifest_match", "w02_overlapped", "c02_run_stage", "x04_edit_distance"):
        assert e.queries()[name](spark, folder).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_empty_tables(spark, folder, tmp_path):
    import __spark_entry__ as e

    for t in ("examples", "experiment_results", "chunk_jobs", "transcription_results", "documents", "stage_config", "embeddings", "events"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("a01_corpus_rates", "w02_overlapped", "c02_run_stage", "x04_edit_distance", "l01_sorted_paths", "j01_manifest_match"):
        assert e.queries()[name](spark, str(tmp_path)).count() == 0


def test_names_need_no_session():
    """The named queries and their SQL can be read where no session is."""
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout.split()[0]) > 100, out.stderr


def every(spark, folder, tmp_path, name, table, rows):
    """A query over the stored table and, for what that lacks, over the rows besides."""
    import __spark_entry__ as e

    stored = spark.read.parquet(f"{folder}/{table}.parquet")
    more = spark.createDataFrame(rows, ", ".join(f"`{c}` {k}" for c, k in stored.dtypes if c in rows[0]))
    stored.unionByName(more, allowMissingColumns=True).write.parquet(f"{tmp_path}/{table}.parquet")
    return spark.read.parquet(f"{tmp_path}/{table}.parquet").collect(), e.queries()[name](spark, str(tmp_path)).collect()


def test_every_transcription_is_corrected(spark, folder, tmp_path):
    rows = [{"result_id": 10**9 + k, "Transcription": t} for k, t in enumerate(["ein großer Fuß", "été “oui”", "привет", "नमस्ते", "你好", None, " plain "])]
    stored, got = every(spark, folder, tmp_path, "c09_context_correction", "transcription_results", rows)
    assert sorted((r.result_id, r.corrected) for r in got) == sorted((r.result_id, f"[{r.File or ''}] {r.Transcription or ''}.") for r in stored)
    assert {r.result_id: r.raw for r in got} == {r.result_id: r.Transcription for r in stored}
    assert {r.question for r in got} == {"How can I help you?"}


BLANK = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
#: Texts whose words return, are few or many, or stand between unusual blanks.
SPOKEN = ["a a a a a a a a a", "no no yes no no yes no no yes no", "a b c a b c a b c a b c a b c a b c", "x", "x y", "x x", "one\u00a0two\tthree  four", "", "  ", " ".join(f"w{k % 17}" for k in range(90)), " ".join(["ha"] * 40), None]


def words_of(text):
    import re

    return [w for w in re.split(BLANK, text) if w]


def brute_merge(p, c, limit=12):
    if p == "" or c in ("", p):
        return p or c
    a, b = words_of(p), words_of(c)
    n = max((n for n in range(min(limit, len(a), len(b)) + 1) if a[len(a) - n :] == b[:n]), default=0)
    return p if n == len(b) else " ".join(a + b[n:])


def spoken(spark, folder, tmp_path, name):
    stored, got = every(spark, folder, tmp_path, name, "experiment_results", [{"result_id": 10**9 + k, "hypothesis": t} for k, t in enumerate(SPOKEN)])
    return [(r.result_id, words_of(r.hypothesis)) for r in stored if r.hypothesis is not None], got


def test_every_text_is_merged(spark, folder, tmp_path):
    texts, got = spoken(spark, folder, tmp_path, "w05_merge_overlap")
    want = {i: brute_merge(" ".join(w[: len(w) // 2 + 1]), " ".join(w[max(len(w) // 2 - 2, 0) :])) for i, w in texts}
    assert len(got) == len(want) and {r.result_id: r.merged for r in got} == want
    assert any(want[i] != " ".join(w) for i, w in texts)


def test_every_text_is_folded(spark, folder, tmp_path):
    from functools import reduce

    texts, got = spoken(spark, folder, tmp_path, "a16_chunk_merge")
    chunks = {i: [" ".join(w[a : a + 8]) for a in range(0, max(len(w) - 3, 1), 5)] for i, w in texts if w}
    want = {i: (reduce(brute_merge, c, ""), len(c)) for i, c in chunks.items()}
    assert len(got) == len(want) and {r.result_id: (r.text, r.n_chunks) for r in got} == want
    assert any(want[i][0] != " ".join(w) for i, w in texts if w)


def by_sql(name, tmp_path, table):
    import duckdb

    import __spark_entry__ as e

    c = duckdb.connect()
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    return sorted(c.execute(e.oracle_sql()[name]).fetchall(), key=str)


def test_tied_clips_stay(spark, folder, tmp_path):
    rows = [{"result_id": 10**9 + k, "speaker_durations": m} for k, m in enumerate([{"P": 2.0, "A": 2.0}, {"C": 0.0, "A": 1.0, "P": 1.0}, {"A": 3.0}])]
    stored, got = every(spark, folder, tmp_path, "a06_longest_speaker", "experiment_results", rows)
    assert len(got) == sum(bool(r.speaker_durations) for r in stored)
    listed = spark.read.parquet(f"{tmp_path}/experiment_results.parquet").filter("result_id >= 1000000000").select("result_id", F.map_entries("speaker_durations").alias("e")).collect()
    first = {r.result_id: next(x.key for x in r.e if x.value == max(y.value for y in r.e)) for r in listed}
    assert {r.clip: r.speaker for r in got if r.clip in first} == first
    assert sorted(map(tuple, got), key=str) == by_sql("a06_longest_speaker", tmp_path, "experiment_results")


def test_console_prints_every_row(spark, folder, tmp_path):
    rows = [{"result_id": 10**9, "stage": None, "wer": 0.25, "rtf_total": float("nan")}, {"result_id": 10**9 + 1, "stage": "raw", "wer": float("nan"), "rtf_total": None}]
    stored, got = every(spark, folder, tmp_path, "k08_console", "experiment_results", rows)
    shown = {r.result_id: r.row for r in got}
    assert len(got) == len(stored)
    assert shown[10**9].startswith(" " * 36 + "    0.2500") and shown[10**9].endswith("       nan") and shown[10**9 + 1].startswith("raw" + " " * 33 + "       nan")
    assert sorted(map(tuple, got), key=str) == by_sql("k08_console", tmp_path, "experiment_results")


def test_five_models_are_run(spark, folder):
    from functools import partial

    import __spark_entry__ as e
    from phonolake.plans import pipelines

    got = {(r.model, r.slice): r.asDict() for r in e.queries()["c11_model_sequence"](spark, folder).collect()}
    examples, jobs = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("examples", "chunk_jobs"))
    alone = {r.slice: r.asDict() for r in pipelines.evaluation(examples, jobs, partial(models.Numbered, 3), 16).collect()}
    assert {m for m, _ in got} == {f"stub-{i}" for i in range(1, 6)} and got["stub-3", "clean"] == alone["clean"] | {"model": "stub-3"}
    assert got["stub-1", "clean"]["n"] == examples.filter("reference is not null").count() and len({got[f"stub-{i}", "clean"]["cer"] for i in range(1, 6)}) > 1

    class Broken(models.Stub):
        def load(self):
            raise RuntimeError("no weights")

    with pytest.raises(Exception, match="no weights"):
        pipelines.sequence(examples, jobs, {"a": models.Stub, "b": Broken}, 16).collect()


def test_voicebot_answers(spark, folder):
    import __spark_entry__ as e

    rows = {r.result_id: r for r in report.scored(spark.read.parquet(f"{folder}/experiment_results.parquet").select("result_id", "reference", "hypothesis")).collect()}
    got = e.queries()["c10_voicebot"](spark, folder).collect()
    assert len(got) == len(rows) and {r.intent for r in got} == {*st.INTENTS, st.UNKNOWN}
    for r in got:
        i, c, raw = r.result_id, rows[r.result_id].counts, rows[r.result_id].hypothesis
        unsure = "YES" if c.reference_words and c.word_errors / c.reference_words > 0.5 else "NO"
        if i % 4 == 0:
            want = ("clean " + (raw or ""), "YES" if i % 8 == 4 else "NO", st.INTENTS[i // 4 % 4], "12")
        else:
            want = ("clean " + (raw or "") if i % 4 == 1 else raw, unsure, st.UNKNOWN, None)
        assert (r.cleaned, r.confirm_slot, r.intent, r.amount) == want


def test_all_references_are_matched(spark, folder):
    import re

    import __spark_entry__ as e

    rows = [r for r in spark.read.parquet(f"{folder}/examples.parquet").collect() if r.audio is not None]
    stem = lambda a: re.sub(r"\.[^.]*$", "", a.split("/")[-1])
    made = []
    for r in rows:
        t = re.sub(BLANK, " ", r.reference or "").strip(" ")
        made.append((r.example_id * 2, stem(r.audio) + ("_p1 ", ": ", ":")[r.example_id % 3] + t))
        if r.example_id % 3 == 0:
            made.append((r.example_id * 2 + 1, f"x_{stem(r.audio)}_p2 {t}"))
    made = [(v.strip(" "), v.strip(" ").split(" ", 1)) for _, v in sorted(made)]
    want = {}
    for a in {r.audio for r in rows}:
        own = [x for x in (stem(a), a.split("/")[-2] if "/" in a else "") if x]
        hits = [p[1] for _, p in made if len(p) > 1 and any(matches(p[0].rstrip(":"), c) for c in own)]
        whole = next((v for v, _ in made if v.startswith(stem(a) + ":")), None)
        if hits or whole:
            want[a] = (" ".join(hits) if hits else whole, len(hits))
    assert {r.audio: (r.reference, r.n_segments) for r in e.queries()["j01_manifest_match"](spark, folder).collect()} == want
    assert len(want) == len({r.audio for r in rows})
    assert {r.audio: r.reference for r in e.queries()["j02_manifest_fallback"](spark, folder).collect()} == {a: t for a, (t, n) in want.items() if not n}


def test_stage_run(spark):
    """All stages over a signal: channel, speakers, detection, denoising, texts and rates; a failing one has its error."""
    from phonolake.plans import pipelines

    examples = spark.createDataFrame([(1, "a/one.wav", "ek do"), (2, "a/two.wav", None)], "example_id bigint, audio string, reference string")
    loud, low = [0.5] * 32, [0.01] * 16
    jobs = spark.createDataFrame([(1, 0, loud + low), (1, 0, loud + low), (1, 1, low), (2, 0, loud), (3, 0, None), (4, 0, [])], "file_index bigint, chunk_index int, audio array<float>")
    config = spark.createDataFrame([("raw", "average", False, False, False), ("right", "right", True, True, True), ("all", "average", True, True, True)], "stage string, channel string, vad boolean, diarization boolean, denoise boolean")
    level = models.Levels(0.02)
    got = {(r.stage, r.file): r for r in pipelines.stage_run(examples, jobs, config, 16, models.Stub, level, level, level).collect()}
    assert set(got) == {(s, f) for s in ("raw", "right", "all") for f in ("a/one.wav", "a/two.wav")}
    one = got["all", "a/one.wav"]
    # the first chunk's halves are as long: the first speaker; its loud samples stay; the second chunk has no speech
    assert (one.original_duration_seconds, one.processed_duration_seconds, one.vad_segments, one.vad_speech_seconds, one.selected_speaker) == (4.0, 1.5, 1, 1.5, "SPEAKER_00")
    assert one.speaker_durations == {"SPEAKER_00": 1.5, "SPEAKER_01": 1.5} and one.wer is not None and one.error is None and one.total_time_seconds >= one.whisper_time_seconds
    assert got["raw", "a/two.wav"].wer is None and got["raw", "a/two.wav"].vad_segments is None and got["raw", "a/one.wav"].processed_duration_seconds == 4.0
    assert got["right", "a/one.wav"].error.startswith("ValueError") and got["right", "a/one.wav"].hypothesis == "" and got["right", "a/one.wav"].processed_duration_seconds is None
    assert list(got["raw", "a/one.wav"].asDict()) == [*pipelines.STAGE_FIELDS, "error"]
    plan = pipelines.stage_run(examples, jobs, config, 16, models.Stub, level, level, level)._jdf.queryExecution().executedPlan().toString()
    assert "audio#" not in "".join(line for line in plan.splitlines() if "Exchange" in line)
    assert pipelines.stage_run(examples, jobs.limit(0), config, 16, models.Stub, level, level, level).count() == 0


def test_speech_spans():
    x = np.array([0, 1, 1, 0, 1, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 1, 1], float)
    assert models.speech_spans(x, 0.5) == [(1, 3), (4, 5), (8, 9), (14, 17)]
    assert models.speech_spans(x, 0.5, least_silence=2) == [(1, 5), (8, 9), (14, 17)]
    assert models.speech_spans(x, 0.5, least_silence=2, least_speech=2) == [(1, 5), (14, 17)]
    assert models.speech_spans(x, 0.5, least_silence=2, least_speech=2, pad=9) == [(0, 9), (9, 17)]
    assert models.speech_spans(x[:1], 0.5) == [] == models.speech_spans(x[:0], 0.5) == models.speech_spans(x, 0.5, least_speech=9)


@pytest.mark.parametrize("text,want", [("", ""), (None, None), ("no digits", "no digits"), ("0 and 7", "zero and seven"), ("42", "forty two"), ("1,250.50 now", "one thousand two hundred fifty point five zero now"), ("12,34,567", "twelve lakh thirty four thousand five hundred sixty seven"), ("007", "zero zero seven"), ("1234567890", "one two three four five six seven eight nine zero"), ("v2.5 a1", "v2.5 a1"), ("at 10.", "at ten."), ("30000000", "three crore")])
def test_digits_to_words(text, want):
    assert models.digits_to_spoken(text) == want


def test_hotwords_reach_the_model(spark):
    jobs = spark.createDataFrame([(i, [0.1 * i] * 100) for i in range(30)], "i int, a array<float>")
    said = {w for r in models.transcribed(jobs, ["i"], "a", 16, models.Stub, hotwords=("Ostrivel",), prompt="p").collect() for w in r.hypothesis.split()}
    assert "Ostrivel" in said and "Ostrivel" not in {w for r in models.transcribed(jobs, ["i"], "a", 16, models.Stub).collect() for w in r.hypothesis.split()}


def test_document_of_many_rows(spark, tmp_path):
    rows = [(i, f"t{i}", None if i % 3 else 1.5) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, t string, x double").repartition(7)
    sinks.document_parts(df, "i", f"{tmp_path}/doc")
    text = "".join(p.read_text() for p in sorted((tmp_path / "doc").glob("part-*")))
    assert json.loads(text) == {"results": [{"i": i, "t": t, "x": x} for i, t, x in rows]}
    sinks.document_parts(df.limit(0), "i", f"{tmp_path}/none")
    assert json.loads("".join(p.read_text() for p in sorted((tmp_path / "none").glob("part-*")))) == {"results": []}


def test_lines_with_many_colons(spark):
    """A long line is not multiplied: only what can be a file's name goes into the join."""
    files = spark.createDataFrame([("d/a:b.wav",), ("d/c.wav",)], "audio string")
    told = spark.createDataFrame([(0, "a:b: first"), (1, "c:" + "x:" * 50_000), (2, "a:b: second")], "line_no bigint, value string")
    none = spark.createDataFrame([], "audio_path string, identifier string")
    got = {r.audio: r.reference for r in manifest.match(files, told, none).collect()}
    assert got["d/c.wav"].startswith("c:x:") and got["d/a:b.wav"] == "first second"


def test_stored_tables_are_released(spark):
    from phonolake.operators import ranks

    df = ranks.stored(spark.range(5).toDF("i"))
    assert df.count() == 5
    ranks.release(spark)
    with pytest.raises(Exception, match="(?i)path|file"):
        df.count()


def test_allowed_texts(spark, folder, tmp_path):
    rows = [{"result_id": 10**9 + k, "Detected Language": lang, "Transcription": text} for k, (lang, text) in enumerate([("en", "call nine one one at 5"), ("hi", "दो सौ रुपये"), ("fr", "à 7 h"), ("", None), (None, "")])]
    stored, got = every(spark, folder, tmp_path, "c06b_allowed_texts", "transcription_results", rows)
    by = {r.result_id: r for r in got}
    assert len(got) == len(stored)
    assert (by[10**9].reason, by[10**9].itn, by[10**9].tn) == (None, "call 911 at 5", "call nine one one at five")
    assert by[10**9 + 1].itn == "200 रुपये" and by[10**9 + 2].reason and by[10**9 + 2].tn == "à seven h" and by[10**9 + 3].raw is None
    for r in stored:
        assert by[r.result_id].tn == models.digits_to_spoken(r.Transcription) and (by[r.result_id].reason is None) == ((r["Detected Language"] or "hi") in ("hi", "en"))
