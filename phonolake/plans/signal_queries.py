"""Named queries of signals, chunks, windows, models, streams and whole pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from phonolake.functions import align, models
from phonolake.functions import signal as sg
from phonolake.functions import structured as st
from phonolake.functions import text as tx
from phonolake.operators import merging, report, segments
from phonolake.plans import pipelines
from phonolake.plans.register import PAIRS, dealt, q, query, table
from phonolake.streaming import turns

VEC = "list_transform(embedding, lambda x: x::DOUBLE)"
RATE = 16


def vectors(spark, folder):
    """The vectors as signals of double samples."""
    return table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("a"))


def total(a):
    return F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)


SUM = "round(list_sum({a}), 6)"


@query("s03_decode_waves", "SELECT file_index, chunk_index, count(*) AS n, max(len(audio))::INT AS samples FROM chunk_jobs WHERE len(audio) > 0 GROUP BY file_index, chunk_index")
def s03(spark, folder):
    """Signals as wave files in memory, and decoded."""
    from phonolake.sources.audio import decode_wave
    from phonolake.sources.sinks import encode_wave

    def run(batch):
        batch["samples"] = [len(decode_wave(encode_wave(x, RATE))[0]) for x in batch["audio"]]
        return batch[["file_index", "chunk_index", "samples"]]

    jobs = table(spark, folder, "chunk_jobs").filter(F.size("audio") > 0).select("file_index", "chunk_index", "audio")
    done = sg.for_each_batch(jobs, run, "file_index bigint, chunk_index int, samples int")
    return done.groupBy("file_index", "chunk_index").agg(F.count(F.lit(1)).alias("n"), F.max("samples").alias("samples"))


@query("s04_channels", f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: a[2 * i - 1])), 6) AS left_sum, round(list_sum(list_transform(range(1, 33), lambda i: a[2 * i])), 6) AS right_sum FROM (SELECT vec_id, {VEC} AS a FROM embeddings)")
def s04(spark, folder):
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.element_at("a", 2 * i + 1), F.element_at("a", 2 * i + 2)))
    v = vectors(spark, folder).withColumn("frames", frames)
    return v.select("vec_id", total(sg.channel(F.col("frames"), "left")).alias("left_sum"), total(sg.channel(F.col("frames"), "right")).alias("right_sum"))


@query("n01_resample", f"SELECT vec_id, i::INT AS i, round(a[k + 1] + (a[least(k + 2, 64)] - a[k + 1]) * (i * 64 / 48.0 - k), 6) AS x FROM (SELECT vec_id, {VEC} AS a, i, floor(i * 64 / 48.0)::INT AS k FROM embeddings, (SELECT unnest(range(48)) AS i))")
def n01(spark, folder):
    return vectors(spark, folder).select("vec_id", F.posexplode(sg.resample(F.col("a"), 64, 48)).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


@query("n02_polyphase")
def n02(spark, folder):
    """Polyphase resampling in Arrow batches."""
    return vectors(spark, folder).select("vec_id", total(sg.polyphase(64, 48)("a")).alias("total"))


ENC = "(sign(x) * ln(1 + 255 * abs(x)) / ln(256.0::DOUBLE))"


@query("n03_mulaw", f"SELECT vec_id, i::INT AS i, round({ENC}, 6) AS encoded, round(sign({ENC}) * (exp(abs({ENC}) * ln(256.0::DOUBLE)) - 1) / 255, 6) AS decoded FROM (SELECT vec_id, i, {VEC}[i + 1] AS x FROM embeddings, (SELECT unnest(range(64)) AS i))")
def n03(spark, folder):
    x = F.col("x")
    rows = vectors(spark, folder).select("vec_id", F.posexplode("a").alias("i", "x"))
    return rows.select("vec_id", "i", F.round(sg.mu_encode(x), 6).alias("encoded"), F.round(sg.mu_decode(sg.mu_encode(x)), 6).alias("decoded"))


@query("n03b_telephony")
def n03b(spark, folder):
    """The telephony slice with its seeded noise."""
    v = report.with_index(vectors(spark, folder), "vec_id", name="seed")
    return sg.telephony(v, "a", 16000, F.col("seed")).select("vec_id", total(F.col("telephony")).alias("total"))


@query("n04_quantized", f"SELECT vec_id, round(list_sum(list_transform({VEC}, lambda x: (greatest(0, least(255, floor(x * 128) + 128)) - 128) / 128.0::DOUBLE)), 6) AS total FROM embeddings")
def n04(spark, folder):
    return vectors(spark, folder).select("vec_id", total(sg.quantized(F.col("a"))).alias("total"))


@query("n05_speed")
def n05(spark, folder):
    """Speed perturbation by the key."""
    v = vectors(spark, folder).withColumn("f", sg.speed_factor(F.col("vec_id")))
    return v.select("vec_id", "f", F.size(sg.change_speed("a", "f")).alias("n"))


@query("n06_gates")
def n06(spark, folder):
    """Augmentation gates by the key."""
    return vectors(spark, folder).select("vec_id", sg.gate(F.col("vec_id"), 0.4, 1).alias("telephony"), sg.gate(F.col("vec_id"), 0.3, 2).alias("speed"))


@query("n07_channel_mean", f"SELECT vec_id, round(list_sum(list_transform(range(1, 33), lambda i: (a[2 * i - 1] + a[2 * i]) / 2)), 6) AS mono_sum FROM (SELECT vec_id, {VEC} AS a FROM embeddings)")
def n07(spark, folder):
    frames = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.array(F.element_at("a", 2 * i + 1), F.element_at("a", 2 * i + 2)))
    return vectors(spark, folder).select("vec_id", total(sg.mono(frames)).alias("mono_sum"))


@query("n08_duration", "SELECT file_index, chunk_index, queued_at, len(audio) / sample_rate AS seconds FROM chunk_jobs WHERE audio IS NOT NULL")
def n08(spark, folder):
    return table(spark, folder, "chunk_jobs").filter("audio is not null").select("file_index", "chunk_index", "queued_at", sg.duration(F.col("audio"), F.col("sample_rate")).alias("seconds"))


@query("n09_rtf", 'SELECT result_id, round("Inference Time (s)" / greatest("Duration (s)", 1e-9), 6) AS rtf FROM transcription_results')
def n09(spark, folder):
    return table(spark, folder, "transcription_results").select("result_id", F.round(sg.rtf(F.col("Inference Time (s)"), F.col("Duration (s)")), 6).alias("rtf"))


@query("n10_rtf_or_zero", 'SELECT result_id, CASE WHEN "Duration (s)" > 0 THEN round("Inference Time (s)" / "Duration (s)", 6) ELSE 0.0 END::DOUBLE AS rtf FROM transcription_results')
def n10(spark, folder):
    return table(spark, folder, "transcription_results").select("result_id", F.round(sg.rtf_or_zero(F.col("Inference Time (s)"), F.col("Duration (s)")), 6).alias("rtf"))


@query("n11_rtf_pair", "SELECT result_id, round(whisper_time_seconds / greatest(processed_duration_seconds, 1e-9), 6) AS rtf_whisper, round((preprocessing_time_seconds + whisper_time_seconds) / greatest(original_duration_seconds, 1e-9), 6) AS rtf_total FROM experiment_results")
def n11(spark, folder):
    c = F.col
    return table(spark, folder, "experiment_results").select("result_id", F.round(sg.rtf(c("whisper_time_seconds"), c("processed_duration_seconds")), 6).alias("rtf_whisper"), F.round(sg.rtf(c("preprocessing_time_seconds") + c("whisper_time_seconds"), c("original_duration_seconds")), 6).alias("rtf_total"))


CONF = "SELECT user_id, round(avg(-value / 100), 3) AS p, round(max(value / 500), 3) AS s FROM events GROUP BY user_id"


def confidences(spark, folder):
    return table(spark, folder, "events").groupBy("user_id").agg(*segments.confidence(-F.col("value") / 100, F.col("value") / 500))


@query("n12_unsure", f"SELECT user_id, p < -0.8 OR s > 0.6 AS unsure FROM ({CONF})")
def n12(spark, folder):
    return confidences(spark, folder).select("user_id", segments.unsure(F.col("avg_logprob"), F.col("no_speech_prob")).alias("unsure"))


@query("n13_unsure_logprob", f"SELECT user_id, p < -0.8 AS unsure FROM ({CONF})")
def n13(spark, folder):
    return confidences(spark, folder).select("user_id", segments.unsure(F.col("avg_logprob")).alias("unsure"))


@query("n14_rounding", "SELECT event_id, round(value, 2) AS two, round(value, 3) AS three FROM events")
def n14(spark, folder):
    return table(spark, folder, "events").select("event_id", F.round("value", 2).alias("two"), F.round("value", 3).alias("three"))


@query("n15_fit_length", f"SELECT vec_id, {SUM.format(a='list_resize(' + VEC + ', (vec_id % 80 + 1)::BIGINT, 0)')} AS total, (vec_id % 80 + 1)::INT AS n FROM embeddings")
def n15(spark, folder):
    n = (F.col("vec_id") % 80 + 1).cast("int")
    return vectors(spark, folder).select("vec_id", total(sg.fit_length(F.col("a"), n)).alias("total"), F.size(sg.fit_length(F.col("a"), n)).alias("n"))


@query("n16_memory", "SELECT run_id, max(gpu_memory_mb) AS peak_mb FROM experiment_results GROUP BY run_id")
def n16(spark, folder):
    """Recorded peaks by run; the engine's own memory is in Spark's task metrics."""
    return table(spark, folder, "experiment_results").groupBy("run_id").agg(F.max("gpu_memory_mb").alias("peak_mb"))


@query("n18_reduction", "SELECT result_id, round((original_duration_seconds - processed_duration_seconds) / nullif(original_duration_seconds, 0) * 100, 4) AS reduction FROM experiment_results")
def n18(spark, folder):
    o, p = F.col("original_duration_seconds"), F.col("processed_duration_seconds")
    return table(spark, folder, "experiment_results").select("result_id", F.round((o - p) / F.nullif(o, F.lit(0.0)) * 100, 4).alias("reduction"))


# ---- chunks --------------------------------------------------------------------------------


def unique_jobs(spark, folder):
    """Jobs that hold samples; one that was queued twice has the same audio."""
    return table(spark, folder, "chunk_jobs").filter(F.size("audio") > 0).select("file_index", "chunk_index", "queued_at", F.col("audio").cast("array<double>").alias("a"))


JOBS = "SELECT file_index, chunk_index, queued_at, list_transform(audio, lambda x: x::DOUBLE) AS a FROM chunk_jobs WHERE len(audio) > 0"


@query("w01_tumbling", f"SELECT file_index, chunk_index, queued_at, k::INT AS piece, {SUM.format(a='a[k * 100 + 1 : k * 100 + 100]')} AS total FROM (SELECT *, unnest(range((len(a) + 99) // 100)) AS k FROM ({JOBS}))")
def w01(spark, folder):
    rows = unique_jobs(spark, folder).select("file_index", "chunk_index", "queued_at", F.explode(sg.tumbling(F.col("a"), 100)).alias("c"))
    return rows.select("file_index", "chunk_index", "queued_at", F.col("c.chunk_index").alias("piece"), total(F.col("c.chunk")).alias("total"))


@query("w02_overlapped", f"SELECT file_index, chunk_index, queued_at, k::INT AS piece, {SUM.format(a='a[k * 80 + 1 : k * 80 + 100]')} AS total FROM (SELECT *, unnest(range(CASE WHEN len(a) <= 100 THEN 1 ELSE ceil((len(a) - 100) / 80.0)::BIGINT + 1 END)) AS k FROM ({JOBS}))")
def w02(spark, folder):
    rows = unique_jobs(spark, folder).select("file_index", "chunk_index", "queued_at", F.explode(sg.overlapped(F.col("a"), 100, 20)).alias("c"))
    return rows.select("file_index", "chunk_index", "queued_at", F.col("c.chunk_index").alias("piece"), total(F.col("c.chunk")).alias("total"))


@query("w03_strided", f"SELECT file_index, chunk_index, queued_at, k::INT AS piece, CASE WHEN k > 0 THEN 80 ELSE 0 END AS stride_left, CASE WHEN k < n - 1 THEN 80 ELSE 0 END AS stride_right FROM (SELECT *, unnest(range(n)) AS k FROM (SELECT *, CASE WHEN len(a) <= 480 THEN 1 ELSE ceil((len(a) - 480) / 400.0)::BIGINT + 1 END AS n FROM ({JOBS})))")
def w03(spark, folder):
    rows = unique_jobs(spark, folder).select("file_index", "chunk_index", "queued_at", F.explode(sg.overlapped(F.col("a"), 480, 80)).alias("c"))
    return rows.select("file_index", "chunk_index", "queued_at", F.col("c.chunk_index").alias("piece"), "c.stride_left", "c.stride_right")


@query("w04_streamed", f"SELECT vec_id, k::INT AS piece, CASE WHEN k = 0 THEN {SUM.format(a='a[1:16]')} ELSE {SUM.format(a='a[14 + (k - 1) * 12 + 1 : 14 + (k - 1) * 12 + 20]')} END AS total FROM (SELECT *, unnest(range(ceil((64 - 14 - 20) / 12.0)::BIGINT + 2)) AS k FROM (SELECT vec_id, {VEC} AS a FROM embeddings))")
def w04(spark, folder):
    """First chunk of 16, then chunks of 20 that start at frame * 4 - 2, four frames at first and three a step."""
    chunks = sg.streamed(F.col("a"), first=16, size=20, hop=4, window=4, first_frames=4, frames=3)
    return vectors(spark, folder).select("vec_id", F.explode(chunks).alias("c")).select("vec_id", F.col("c.chunk_index").alias("piece"), total(F.col("c.chunk")).alias("total"))


#: Words of a hypothesis by blanks of any kind; two lists of words as one, without the longest run (twelve at most) that ends the first and begins the second.
WORDS_SQL = "list_filter(string_split(regexp_replace(hypothesis, '[\\s\\x0b\\x85\\p{Z}]+', ' ', 'g'), ' '), lambda w: w <> '')"
MERGED_SQL = "CASE WHEN len({a}) = 0 THEN {b} WHEN {a} = {b} THEN {a} ELSE list_concat({a}, {b}[coalesce(list_max(list_filter(range(1, least(12, len({a}), len({b})) + 1), lambda n: {a}[len({a}) - n + 1 :] = {b}[1:n])), 0) + 1 :]) END"


@query("w05_merge_overlap", f"SELECT result_id, array_to_string({MERGED_SQL.format(a='l', b='r')}, ' ') AS merged FROM (SELECT result_id, w[1 : len(w) // 2 + 1] AS l, w[greatest(len(w) // 2 - 1, 1) :] AS r FROM (SELECT result_id, {WORDS_SQL} AS w FROM experiment_results WHERE hypothesis IS NOT NULL))")
def w05(spark, folder):
    """Every text, cut into halves that share three words where it has them, and merged; words may return, so the longest overlap may be longer."""
    e = table(spark, folder, "experiment_results").filter("hypothesis is not null").select("result_id", merging.words(F.col("hypothesis")).alias("w"))
    half = F.floor(F.size("w") / 2).cast("int")
    left, right = F.array_join(F.slice("w", F.lit(1), half + 1), " "), F.array_join(F.slice("w", F.greatest(half - 1, F.lit(1)), F.size("w")), " ")
    return e.select("result_id", merging.merge(left, right).alias("merged"))


@query("a16_chunk_merge", f"SELECT result_id, array_to_string(list_reduce(list_transform(range(n), lambda k: w[k * 5 + 1 : k * 5 + 8]), lambda x, y: {MERGED_SQL.format(a='x', b='y')}), ' ') AS text, n AS n_chunks FROM (SELECT *, CASE WHEN len(w) <= 8 THEN 1 ELSE ceil((len(w) - 8) / 5.0) + 1 END::BIGINT AS n FROM (SELECT result_id, {WORDS_SQL} AS w FROM experiment_results) WHERE len(w) > 0)")
def a16(spark, folder):
    """Every text that isn't blank, cut into chunks of eight that share three and merged again in order; where words return, a merge may take more than was shared."""
    e = table(spark, folder, "experiment_results").select("result_id", merging.words(F.col("hypothesis")).alias("w")).filter(F.size("w") > 0)
    chunks = e.select("result_id", F.explode(sg.overlapped(F.col("w"), 8, 3)).alias("c")).select("result_id", "c.chunk_index", F.array_join("c.chunk", " ").alias("text"))
    return merging.fold(chunks, "result_id", "chunk_index", "text")


@query("w06_seed_index", "SELECT audio, idx, r IS NOT NULL AS has_reference FROM (SELECT audio, max(reference) AS r, row_number() OVER (ORDER BY audio) - 1 AS idx FROM examples GROUP BY audio)")
def w06(spark, folder):
    """Seeds are numbered over all recordings, before any filter."""
    files = table(spark, folder, "examples").groupBy("audio").agg(F.max("reference").alias("r"))
    return report.with_index(files, "audio").select("audio", "idx", F.col("r").isNotNull().alias("has_reference"))


ISLANDS = """
WITH e AS (SELECT user_id, epoch(ts)::DOUBLE AS s FROM events WHERE ts IS NOT NULL),
g AS (SELECT *, CASE WHEN s - lag(s) OVER (PARTITION BY user_id ORDER BY s) <= 3600 THEN 0 ELSE 1 END AS fresh FROM e),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, round(min(s), 3) AS start, round(max(s), 3) AS "end", count(*) AS n FROM r GROUP BY user_id, run
"""


def seconds(column: str):
    return (F.unix_micros(F.col(column).cast("timestamp")) / 1e6).cast("double")


@query("w07_islands", ISLANDS)
def w07(spark, folder):
    e = table(spark, folder, "events")
    runs = segments.islands(e, "user_id", seconds("ts"), seconds("ts"), 3600.0)
    return runs.select("user_id", F.round("start", 3).alias("start"), F.round("end", 3).alias("end"), "n")


LOUD = """
WITH j AS (SELECT file_index, chunk_index, any_value(audio) AS audio FROM chunk_jobs WHERE len(audio) > 0 GROUP BY ALL),
x AS (SELECT file_index, chunk_index, unnest(range(len(audio))) AS i, unnest(audio) AS v FROM j),
l AS (SELECT *, i - row_number() OVER (PARTITION BY file_index, chunk_index ORDER BY i) AS g FROM x WHERE abs(v) >= 0.02::FLOAT)
SELECT file_index, chunk_index, min(i)::BIGINT AS start, max(i)::BIGINT + 1 AS "end" FROM l GROUP BY file_index, chunk_index, g
"""


def loud_runs(batch):
    import numpy as np
    import pandas as pd

    rows = []
    for f, c, a in zip(batch["file_index"], batch["chunk_index"], batch["audio"], strict=True):
        edge = np.diff(np.concatenate([[0], (np.abs(np.asarray(a, np.float32)) >= np.float32(0.02)).view(np.int8), [0]]))
        rows += [(f, c, s, e) for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
    return pd.DataFrame(rows, columns=["file_index", "chunk_index", "start", "end"])


@query("w07b_speech_spans", LOUD)
def w07b(spark, folder):
    """Speech spans of the signals by level."""
    jobs = table(spark, folder, "chunk_jobs").filter(F.size("audio") > 0).select("file_index", "chunk_index", "audio")
    return sg.for_each_batch(jobs, loud_runs, "file_index bigint, chunk_index int, start bigint, end bigint").dropDuplicates()


VAD_SQL = """
WITH j AS (SELECT file_index, chunk_index, any_value(audio) AS audio, any_value(len(audio)) AS n FROM chunk_jobs WHERE len(audio) > 0 GROUP BY ALL),
x AS (SELECT file_index, chunk_index, n, unnest(range(len(audio))) AS i, unnest(audio) AS v FROM j),
l AS (SELECT *, CASE WHEN i - lag(i) OVER w - 1 < 8 THEN 0 ELSE 1 END AS fresh FROM x WHERE abs(v) >= 0.05::FLOAT WINDOW w AS (PARTITION BY file_index, chunk_index ORDER BY i)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY file_index, chunk_index ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM l),
r AS (SELECT file_index, chunk_index, n, min(i) AS s, max(i) + 1 AS e FROM g GROUP BY file_index, chunk_index, n, g HAVING max(i) + 1 - min(i) >= 4)
SELECT file_index, chunk_index, greatest(s - 3, 0)::BIGINT AS start, least(e + 3, n)::BIGINT AS "end" FROM r
"""


@query("w07c_vad", VAD_SQL)
def w07c(spark, folder):
    """Speech with its limits: a higher level, pauses of half a second, speech of a quarter, and padding."""
    import pandas as pd

    def run(batch):
        found = zip(batch["file_index"], batch["chunk_index"], batch["audio"], strict=True)
        rows = [(f, c, s, e) for f, c, a in found for s, e in models.speech_spans(a, 0.05, least_speech=4, least_silence=8, pad=3)]
        return pd.DataFrame(rows, columns=["file_index", "chunk_index", "start", "end"])

    jobs = table(spark, folder, "chunk_jobs").filter(F.size("audio") > 0).select("file_index", "chunk_index", "audio")
    return sg.for_each_batch(jobs, run, "file_index bigint, chunk_index int, start bigint, end bigint").dropDuplicates()


@query("w08_trailing_silence", "SELECT result_id, round(greatest(0, original_duration_seconds - coalesce(vad_speech_seconds, 0)), 6) AS silence, greatest(0, original_duration_seconds - coalesce(vad_speech_seconds, 0)) >= 0.8 AS finished FROM experiment_results")
def w08(spark, folder):
    silence = segments.trailing_silence(F.col("original_duration_seconds"), F.col("vad_speech_seconds"))
    return table(spark, folder, "experiment_results").select("result_id", F.round(silence, 6).alias("silence"), segments.turn_finished(silence, F.lit(True)).alias("finished"))


@query("w09_vad_finished", "SELECT result_id, CASE WHEN coalesce(vad_segments, 0) = 0 THEN true ELSE greatest(0, original_duration_seconds - coalesce(vad_speech_seconds, 0)) >= 0.8 END AS finished FROM experiment_results")
def w09(spark, folder):
    silence = segments.trailing_silence(F.col("original_duration_seconds"), F.col("vad_speech_seconds"))
    return table(spark, folder, "experiment_results").select("result_id", segments.turn_finished(silence, F.coalesce("vad_segments", F.lit(0)) > 0).alias("finished"))


@query("w10_batches", "SELECT result_id, ((row_number() OVER (ORDER BY result_id) - 1) // 4)::BIGINT AS batch_id FROM transcription_results")
def w10(spark, folder):
    return report.batches(table(spark, folder, "transcription_results").select("result_id"), 4, "result_id").select("result_id", "batch_id")


@query("w11_batch_time", 'SELECT result_id, round(t / count(*) OVER (PARTITION BY b), 6) AS share FROM (SELECT result_id, "Inference Time (s)" AS t, (row_number() OVER (ORDER BY result_id) - 1) // 4 AS b FROM transcription_results)')
def w11(spark, folder):
    rows = report.batches(table(spark, folder, "transcription_results").select("result_id", F.col("Inference Time (s)").alias("t")), 4, "result_id")
    return report.attributed(rows, "t").select("result_id", F.round("share", 6).alias("share"))


@query("a07_extract_speaker", f"SELECT vec_id, {SUM.format(a='list_concat(a[9:16], a[41:56])')} AS total, 24 AS n FROM (SELECT vec_id, {VEC} AS a FROM embeddings)")
def a07(spark, folder):
    """Turns in seconds at 16 samples a second; the second speaker's are left out."""
    turn = lambda s, e, who: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(who).alias("speaker"))
    own = F.array(turn(0.5, 1.0, "A"), turn(1.0, 2.5, "B"), turn(2.5, 3.5, "A"))
    x = sg.speaker_slices(F.col("a"), F.lit(RATE), own, F.lit("A"))
    return vectors(spark, folder).select("vec_id", total(x).alias("total"), F.size(x).alias("n"))


@query("a08_speech_concat", f"SELECT vec_id, {SUM.format(a='list_concat(a[1:10], a[61:64])')} AS total FROM (SELECT vec_id, {VEC} AS a FROM embeddings)")
def a08(spark, folder):
    """Spans that end where they start, or beyond the end, give what is there."""
    span = lambda s, e: F.struct(F.lit(s).alias("start"), F.lit(e).alias("end"))
    x = sg.slices(F.col("a"), F.array(span(0, 10), span(20, 20), span(60, 90)))
    return vectors(spark, folder).select("vec_id", total(x).alias("total"))


@query("u04_slices", f"SELECT vec_id, {SUM.format(a='list_concat(a[33:64], a[1:32])')} AS total FROM (SELECT vec_id, {VEC} AS a FROM embeddings)")
def u04(spark, folder):
    halves = F.flatten(F.array(F.slice("a", 33, 32), F.slice("a", 1, 32)))
    return vectors(spark, folder).select("vec_id", total(halves).alias("total"))


# ---- models and streams --------------------------------------------------------------------


@query("f01_transcribe")
def f01(spark, folder):
    """Every job through the model interface with the stand-in model."""
    return models.transcribed(table(spark, folder, "chunk_jobs"), ["file_index", "chunk_index", "queued_at"], "audio", RATE, models.Stub)


class Marked:
    """A stand-in for a correcting model: the text with its context before it and a mark behind."""

    def correct(self, texts, contexts):
        return [f"[{c}] {t}." for t, c in zip(texts, contexts, strict=True)]


CORRECTED = "'[' || coalesce(File, '') || '] ' || coalesce(Transcription, '') || '.'"


@query("f08_hotwords")
def f08(spark, folder):
    """Every job with hotwords and a prompt for the decoder."""
    return models.transcribed(table(spark, folder, "chunk_jobs"), ["file_index", "chunk_index", "queued_at"], "audio", RATE, models.Stub, hotwords=("Selquora", "Ostrivel"), prompt="A helpline call.")


@query("f10_correct", f"SELECT result_id, {CORRECTED} AS corrected FROM transcription_results")
def f10(spark, folder):
    """Every transcription through the correction interface; a failure leaves the raw text."""
    return models.corrected(table(spark, folder, "transcription_results"), ["result_id"], "Transcription", "File", Marked)


@query("st01_turns", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 600 SECOND THEN 0 ELSE 1 END AS fresh FROM events WHERE ts IS NOT NULL), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT user_id, round(epoch(min(ts)), 3) AS turn_start, round(epoch(max(ts)) + 600, 3) AS turn_end, count(*) AS n FROM r GROUP BY user_id, run")
def st01(spark, folder):
    """The streaming rule over the stored events."""
    done = turns.turns(table(spark, folder, "events"), "user_id", "ts", gap="600 seconds")
    return done.select("user_id", F.round(seconds("turn_start"), 3).alias("turn_start"), F.round(seconds("turn_end"), 3).alias("turn_end"), "n")


@query("st02_windowed", "SELECT epoch(time_bucket(INTERVAL 1 HOUR, ts))::BIGINT AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def st02(spark, folder):
    done = turns.windowed(table(spark, folder, "events"), "ts", "1 hour", ["event_type"])
    return done.select(F.unix_seconds("window_start").alias("window_start"), "event_type", "n")


@query("st03_streamed_turns")
def st03(spark, folder):
    """The rule on a stream of the event files: turns that the watermark has passed, stored exactly once."""
    from phonolake.operators.ranks import fresh_path

    at = fresh_path(spark)
    # a pattern, as a stream's path may be a folder or many files, not one file
    stream = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parque[t]")
    done = turns.turns(stream, "user_id", "ts", gap="600 seconds", late="1 hour")
    turns.store(done, f"{at}/turns", f"{at}/progress").awaitTermination()
    return spark.read.schema(done.schema).parquet(f"{at}/turns")


# ---- pipelines -----------------------------------------------------------------------------


@query("c01_run_evaluation")
def c01(spark, folder):
    """Jobs, stand-in model, texts of a recording in order, scores, rates by slice."""
    return pipelines.evaluation(table(spark, folder, "examples"), table(spark, folder, "chunk_jobs"), models.Stub, RATE)


@query("c02_run_stage", "SELECT stage, count(*) AS n, round(sum(processed), 3) AS processed FROM (SELECT c.stage, CASE WHEN c.channel = 'right' THEN NULL WHEN c.vad THEN p.loud ELSE p.n END / 16.0::DOUBLE AS processed FROM (SELECT file_index, chunk_index, any_value(len(audio)) AS n, any_value(len(list_filter(audio, lambda x: abs(x) >= 0.02::FLOAT))) AS loud FROM chunk_jobs WHERE len(audio) > 0 GROUP BY ALL) p CROSS JOIN stage_config c) GROUP BY stage")
def c02(spark, folder):
    """Every stage over every job: what is left after speech detection by level; a stage that can't run has none."""
    done = pipelines.stages(table(spark, folder, "chunk_jobs"), table(spark, folder, "stage_config"), RATE)
    return done.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("processed_duration_seconds"), 3).alias("processed"))


@query("c03_failed_stages", "SELECT stage, channel = 'right' AS failed, count(*) AS n FROM (SELECT DISTINCT file_index, chunk_index FROM chunk_jobs WHERE len(audio) > 0) CROSS JOIN stage_config GROUP BY ALL")
def c03(spark, folder):
    """A stage that can't run (right channel of one channel) is a row with its error, and the others go on."""
    done = pipelines.stages(table(spark, folder, "chunk_jobs"), table(spark, folder, "stage_config"), RATE)
    return done.groupBy("stage", F.col("error").isNotNull().alias("failed")).agg(F.count(F.lit(1)).alias("n"))


@query("c02b_stage_results")
def c02b(spark, folder):
    """The results of every stage for every recording, with stand-ins for the models."""
    level = models.Levels(0.05, least_speech=4, least_silence=8, pad=3)
    return pipelines.stage_run(table(spark, folder, "examples"), table(spark, folder, "chunk_jobs"), table(spark, folder, "stage_config"), RATE, models.Stub, level, level, level)


@query("c04_baseline_table", 'SELECT result_id, File AS file, "Detected Language" AS language, CASE WHEN "Duration (s)" > 0 THEN round("Inference Time (s)" / "Duration (s)", 3) ELSE 0.0 END::DOUBLE AS rtf, trim(Transcription) AS text FROM transcription_results')
def c04(spark, folder):
    return pipelines.baseline(table(spark, folder, "transcription_results"))


@query("c05_keyword_experiment", "WITH k AS (SELECT file, stage, len(list_filter(['refund', 'order', 'status'], lambda k: contains(lower(coalesce(hypothesis, '')), k)))::INT AS hits FROM experiment_results) SELECT file, min(hits) FILTER (WHERE stage = 'raw') AS raw, min(hits) FILTER (WHERE stage = 'vad') AS vad FROM k GROUP BY file")
def c05(spark, folder):
    return pipelines.keyword_experiment(table(spark, folder, "experiment_results"), ["refund", "order", "status"], ["raw", "vad"])


@query("c06_filter_summary", "SELECT File AS file, count(*) FILTER (WHERE l IN ('hi', 'en')) AS kept, count(*) FILTER (WHERE l NOT IN ('hi', 'en')) AS rejected FROM (SELECT File, coalesce(nullif(\"Detected Language\", ''), 'hi') AS l FROM transcription_results) GROUP BY File")
def c06(spark, folder):
    return pipelines.filter_summary(table(spark, folder, "transcription_results"), ["hi", "en"])


@query("c06b_allowed_texts")
def c06b(spark, folder):
    """Every transcription with the reason why its language is rejected, its spoken numbers as digits, and its digits as words; the tests compare them."""
    rows = table(spark, folder, "transcription_results")
    label = F.when(F.col("Detected Language") != "", F.col("Detected Language"))
    kept = rows.select("result_id", "File", F.col("Transcription").alias("raw"), segments.allowed_language(label, F.lit("hi"), ["hi", "en"]).alias("reason"), F.coalesce(label, F.lit("hi")).alias("lang"))
    return kept.select("result_id", F.col("File").alias("file"), "reason", "raw", models.inverse_normalized(F.col("raw"), F.col("lang")).alias("itn"), models.text_normalized(F.col("raw")).alias("tn"))


EVENTS_SQL = f"""
WITH c AS ({CONF}),
t AS (SELECT user_id, round(epoch((SELECT max(ts) FROM events)) - epoch(max(ts)), 3) AS silence FROM events GROUP BY user_id),
k AS (SELECT user_id, string_agg(event_type, ', ' ORDER BY rk) AS events FROM (SELECT user_id, event_type, avg(value) AS m, row_number() OVER (PARTITION BY user_id ORDER BY avg(value) DESC, event_type DESC) AS rk FROM events GROUP BY user_id, event_type) WHERE rk <= 3 GROUP BY user_id)
SELECT c.user_id, p AS avg_logprob, s AS no_speech_prob, CASE WHEN p < -0.8 OR s > 0.6 THEN 'YES' ELSE 'NO' END AS unsure, silence, CASE WHEN silence >= 0.8 THEN 'YES' ELSE 'NO' END AS finished, events FROM c JOIN t USING (user_id) JOIN k USING (user_id)
"""


@query("c07_confidence_events", EVENTS_SQL)
def c07(spark, folder):
    """Confidence, end of turn and the strongest events of each clip; here a user's events stand for a clip's frames."""
    e = table(spark, folder, "events")
    last = e.groupBy("user_id").agg(F.max(seconds("ts")).alias("last"))
    end = e.agg(F.max(seconds("ts")).alias("end"))
    silence = last.crossJoin(end).select("user_id", F.round(segments.trailing_silence(F.col("end"), F.col("last")), 3).alias("silence"))
    classes = segments.top_classes(e.select("user_id", F.col("event_type").alias("class_idx"), F.col("event_type").alias("class"), F.col("value").alias("score")), "user_id", 3)
    rows = confidences(spark, folder).join(silence, "user_id").join(classes, "user_id")
    flags = tx.yes_no(segments.unsure(F.col("avg_logprob"), F.col("no_speech_prob"))).alias("unsure"), tx.yes_no(segments.turn_finished(F.col("silence"), F.lit(True))).alias("finished")
    return rows.select("user_id", "avg_logprob", "no_speech_prob", *flags, "silence", F.regexp_replace("classes", r" \([^)]*\)", "").alias("events"))


ENDPOINT_SQL = """
SELECT result_id, file, original_duration_seconds AS seconds, whisper_time_seconds AS inference_seconds, coalesce(vad_segments, 0) AS segments, vad_speech_seconds AS last_speech_end, greatest(0, original_duration_seconds - coalesce(vad_speech_seconds, 0)) AS silence,
  CASE WHEN coalesce(vad_segments, 0) = 0 OR original_duration_seconds - coalesce(vad_speech_seconds, 0) >= 0.8 THEN 'YES' ELSE 'NO' END AS finished, hypothesis AS transcript FROM experiment_results
"""


@query("c08_vad_endpoint", ENDPOINT_SQL)
def c08(spark, folder):
    """The table of the speech detector: its segments, the silence at the end, and whether the turn is over."""
    silence = segments.trailing_silence(F.col("original_duration_seconds"), F.col("vad_speech_seconds"))
    n = F.coalesce("vad_segments", F.lit(0))
    c = F.col
    return table(spark, folder, "experiment_results").select("result_id", "file", c("original_duration_seconds").alias("seconds"), c("whisper_time_seconds").alias("inference_seconds"), n.alias("segments"), c("vad_speech_seconds").alias("last_speech_end"), silence.alias("silence"), tx.yes_no(segments.turn_finished(silence, n > 0)).alias("finished"), c("hypothesis").alias("transcript"))


QUESTION = "How can I help you?"


@query("c09_context_correction", f"SELECT result_id, File AS file, {q(QUESTION)} AS question, Transcription AS raw, {CORRECTED} AS corrected, \"Inference Time (s)\" AS seconds FROM transcription_results")
def c09(spark, folder):
    """Every transcription with its question, as it is and corrected."""
    rows = table(spark, folder, "transcription_results")
    done = models.corrected(rows, ["result_id", "File", "Transcription", "Inference Time (s)"], "Transcription", "File", Marked)
    return done.select("result_id", F.col("File").alias("file"), F.lit(QUESTION).alias("question"), F.col("Transcription").alias("raw"), "corrected", F.col("Inference Time (s)").alias("seconds"))


@query("c11_model_sequence")
def c11(spark, folder):
    """The evaluation with five stand-in models: transcribed, scored, by slice and model."""
    from functools import partial

    makes = {f"stub-{i}": partial(models.Numbered, i) for i in range(1, 6)}
    return pipelines.sequence(table(spark, folder, "examples"), table(spark, folder, "chunk_jobs"), makes, RATE)


def answers(text):
    """Answers of a stand-in by the key: whole, without most keys, no JSON, and cut short."""
    k = F.col("result_id") % 4
    intent = F.element_at(F.array(*map(F.lit, st.INTENTS)), (F.floor(F.col("result_id") / 4) % 4 + 1).cast("int"))
    cleaned = F.concat(F.lit("clean "), text).alias("cleaned_transcript")
    whole = F.to_json(F.struct(cleaned, intent.alias(st.INTENT_KEY), F.struct(F.lit("12").alias("amount")).alias("entities"), (F.col("result_id") % 8 == 4).alias(st.CONFIRM_KEY)))
    return F.when(k == 0, whole).when(k == 1, F.to_json(F.struct(cleaned))).when(k == 2, F.concat(F.lit("not json "), text)).otherwise(F.lit('{"intent": "refund_issue"'))


INTENTS_SQL = "[" + ", ".join(map(q, st.INTENTS)) + "]"
VOICEBOT = f"""
SELECT result_id, CASE WHEN k < 2 THEN 'clean ' || coalesce(hypothesis, '') ELSE hypothesis END AS cleaned, CASE WHEN CASE WHEN k = 0 THEN result_id % 8 = 4 ELSE unsure END THEN 'YES' ELSE 'NO' END AS confirm_slot,
  CASE WHEN k = 0 THEN {INTENTS_SQL}[(result_id // 4) % 4 + 1] ELSE 'unknown' END AS intent, CASE WHEN k = 0 THEN '12' END AS amount
FROM (SELECT *, result_id % 4 AS k, reference_words > 0 AND word_errors / reference_words > 0.5 AS unsure FROM p)
"""


@query("c10_voicebot", PAIRS + VOICEBOT)
def c10(spark, folder):
    """The voicebot table with valid answers, answers that lack keys, and answers that aren't JSON."""
    rows = dealt(spark, folder, "experiment_results", "result_id", "reference", "hypothesis").filter("reference is not null")
    words = lambda c: tx.words(F.coalesce(c, F.lit("")))
    # the words alone: no use is made of the distance of the characters
    rate = align.let(F.struct(words(F.col("reference")).alias("r"), words(F.col("hypothesis")).alias("h")), lambda s: align.rate(align.token_distance(s["r"], s["h"]), F.size(s["r"])))
    unsure = F.coalesce(rate > 0.5, F.lit(False))
    a = st.parse_answer(answers(F.coalesce("hypothesis", F.lit(""))), F.col("hypothesis"), unsure)
    done = rows.select("result_id", a.alias("a"))
    return done.select("result_id", F.col("a.cleaned_transcript").alias("cleaned"), tx.yes_no(F.col("a.requires_confirmation")).alias("confirm_slot"), "a.intent", "a.entities.amount")
