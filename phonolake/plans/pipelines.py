"""Whole runs as one plan each."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.functions import align, models
from phonolake.functions import signal as sg
from phonolake.functions import text as tx
from phonolake.operators import merging, report, segments

LEVEL = 0.02


def evaluation(examples: DataFrame, jobs: DataFrame, make: Callable[[], models.Model], rate: int) -> DataFrame:
    """Rates by slice: jobs through the model, texts of a recording merged in order, scored once, summed by slice.

    A recording without jobs has an empty hypothesis. The code-mixed slice takes the
    recordings whose reference mixes scripts.
    """
    # a job that is queued twice meets as a small row: no signal is shuffled
    texts = models.transcribed(jobs, ["file_index", "chunk_index"], "audio", rate, make).dropDuplicates(["file_index", "chunk_index"])
    merged = merging.fold(texts, "file_index", "chunk_index", "hypothesis")
    rows = examples.filter(F.col("reference").isNotNull()).join(merged.withColumnsRenamed({"file_index": "example_id", "text": "hypothesis"}), "example_id", "left")
    rows = report.scored(rows.withColumn("hypothesis", F.coalesce("hypothesis", F.lit(""))))
    mixed = tx.is_code_mixed(tx.normalize(F.col("reference")))
    sliced = rows.withColumn("slice", F.explode(F.when(mixed, F.array(F.lit("clean"), F.lit("code_mixed"))).otherwise(F.array(F.lit("clean")))))
    return report.corpus_rates(sliced, "slice")


def sequence(examples: DataFrame, jobs: DataFrame, makes: dict[str, Callable[[], models.Model]], rate: int) -> DataFrame:
    """The evaluation of several models, one after the other, as one table with the model's name.

    A model that can't be loaded ends the whole run, as the first failing one of a sequence
    does; a single signal that a model can't transcribe has an empty hypothesis.
    """
    runs = [evaluation(examples, jobs, make, rate).withColumn("model", F.lit(name)) for name, make in makes.items()]
    out = runs[0]
    for run in runs[1:]:
        out = out.unionByName(run)
    return out


def stages(jobs: DataFrame, config: DataFrame, rate: int) -> DataFrame:
    """Every stage of a config over every job, in the order channel, speakers, detection.

    Gives stage, ids, original and processed seconds and error. The signals have one channel,
    so a stage on the right one fails: it has its error, and the others go on. Detection is by
    level; speakers and denoising are models and leave the signal as it is here. The samples are
    counted where the signal lies, in Arrow batches; only small rows meet the config.
    """
    def run(batch: pd.DataFrame) -> pd.DataFrame:
        out = batch[["file_index", "chunk_index"]].copy()
        out["n"] = [len(a) for a in batch["audio"]]
        out["loud"] = [int((np.abs(np.asarray(a, np.float32)) >= np.float32(LEVEL)).sum()) for a in batch["audio"]]
        return out

    held = jobs.filter(F.size("audio") > 0).select("file_index", "chunk_index", "audio")
    counted = sg.for_each_batch(held, run, "file_index bigint, chunk_index int, n bigint, loud bigint").dropDuplicates(["file_index", "chunk_index"])
    rows = counted.crossJoin(config.select("stage", "channel", "vad"))
    bad = F.col("channel") == "right"
    left = F.when(~bad, F.when(F.col("vad"), F.col("loud")).otherwise(F.col("n")) / rate)
    error = F.when(bad, "right channel of a single-channel signal")
    return rows.select("stage", "file_index", "chunk_index", (F.col("n") / rate).alias("original_duration_seconds"), left.alias("processed_duration_seconds"), error.alias("error"))


#: Fields of a stage's result, in the usual order.
STAGE_FIELDS = ["stage", "file", "reference", "hypothesis", "original_duration_seconds", "processed_duration_seconds", "preprocessing_time_seconds", "whisper_time_seconds", "total_time_seconds", "rtf_whisper", "rtf_total", "wer", "cer", "vad_segments", "vad_speech_seconds", "selected_speaker", "speaker_durations", "gpu_memory_mb"]
#: A stage config is a small table; more rows than these are an error, as it goes to the driver.
STAGES = 1000


def stage_run(examples: DataFrame, jobs: DataFrame, config: DataFrame, rate: int, make: Callable[[], models.Model], detector: models.Detector, diarizer: models.Diarizer, denoiser: models.Denoiser) -> DataFrame:
    """Every stage over every job: channel, speakers, detection, denoising, transcription; then its texts by recording with rates. Gives ``STAGE_FIELDS`` and error.

    A signal goes through all stages where it lies; what leaves the worker are small rows. A
    stage that fails for a signal has an error and the others go on; the error of a recording is
    that of its first failing chunk. The target speaker is the one who speaks longest, the first
    heard of equal ones.
    """
    plan = [r.asDict() for r in config.select("stage", "channel", "vad", "diarization", "denoise").limit(STAGES + 1).collect()]
    if len(plan) > STAGES:
        raise ValueError(f"more than {STAGES} stages")

    def one(model: models.Model, x: np.ndarray, c: dict) -> dict:
        began = time.perf_counter()
        if c["channel"] == "right":
            raise ValueError("right channel of a single-channel signal")
        out = {"selected_speaker": None, "speaker_durations": None, "vad_segments": None, "vad_speech_seconds": None}
        y = x
        if c["diarization"]:
            turns = diarizer.turns(y, rate)
            totals: dict[str, float] = {}
            for start, end, who in turns:
                totals[who] = totals.get(who, 0.0) + max(end - start, 0.0)
            target = max(totals, key=totals.get) if totals else None
            out |= {"selected_speaker": target, "speaker_durations": totals}
            y = np.concatenate([y[int(s * rate) : int(e * rate)] for s, e, who in turns if who == target] or [y[:0]])
        if c["vad"]:
            spans = detector.spans(y, rate)
            out |= {"vad_segments": len(spans), "vad_speech_seconds": sum(e - s for s, e in spans) / rate}
            y = np.concatenate([y[s:e] for s, e in spans] or [y[:0]])
        if c["denoise"]:
            y = denoiser.clean(y, rate)
        ready = time.perf_counter()
        text = models.hypothesis_text(model.transcribe([y], rate)[0]) if len(y) else ""
        return out | {"hypothesis": text, "processed_duration_seconds": len(y) / rate, "preprocessing_time_seconds": ready - began, "whisper_time_seconds": time.perf_counter() - ready}

    names = ["stage", "file_index", "chunk_index", "hypothesis", "original_duration_seconds", "processed_duration_seconds", "preprocessing_time_seconds", "whisper_time_seconds", "vad_segments", "vad_speech_seconds", "selected_speaker", "speaker_durations", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        model.load()
        for batch in batches:
            rows = []
            for f, k, x in zip(batch["file_index"], batch["chunk_index"], batch["audio"], strict=True):
                x = np.asarray(x, np.float32)
                for c in plan:
                    row = dict.fromkeys(names) | {"stage": c["stage"], "file_index": f, "chunk_index": k, "original_duration_seconds": len(x) / rate}
                    try:
                        row |= one(model, x, c)
                    except Exception as e:  # noqa: BLE001  (a failing stage is a row with its error)
                        row["error"] = f"{type(e).__name__}: {e}"
                    rows.append(row)
            yield pd.DataFrame(rows, columns=names, dtype=object)

    held = jobs.filter(F.size("audio") > 0).select("file_index", "chunk_index", "audio")
    schema = "stage string, file_index bigint, chunk_index int, hypothesis string, original_duration_seconds double, processed_duration_seconds double, preprocessing_time_seconds double, whisper_time_seconds double, vad_segments int, vad_speech_seconds double, selected_speaker string, speaker_durations map<string,double>, error string"
    chunks = held.mapInPandas(run, schema).dropDuplicates(["stage", "file_index", "chunk_index"])
    texts = merging.fold(chunks.withColumn("key", F.struct("stage", "file_index")), "key", "chunk_index", "hypothesis").select("key.*", F.col("text").alias("hypothesis"))
    sums = ["original_duration_seconds", "processed_duration_seconds", "preprocessing_time_seconds", "whisper_time_seconds", "vad_segments", "vad_speech_seconds"]
    facts = chunks.groupBy("stage", "file_index").agg(*[F.sum(c).alias(c) for c in sums], F.min_by("selected_speaker", "chunk_index").alias("selected_speaker"), F.min_by("speaker_durations", "chunk_index").alias("speaker_durations"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_index"))).alias("error"))
    rows = facts.join(texts, ["stage", "file_index"]).join(examples.select(F.col("example_id").alias("file_index"), F.col("audio").alias("file"), "reference"), "file_index", "left")
    counts = align.counts(tx.normalize(F.col("reference")), tx.normalize(F.col("hypothesis")))
    rows = rows.withColumn("m", F.when(F.col("reference").isNotNull(), align.metric(counts)))
    total = F.col("preprocessing_time_seconds") + F.col("whisper_time_seconds")
    rows = rows.withColumns({"total_time_seconds": total, "rtf_whisper": sg.rtf(F.col("whisper_time_seconds"), F.col("processed_duration_seconds")), "rtf_total": sg.rtf(total, F.col("original_duration_seconds")), "wer": F.col("m.wer"), "cer": F.col("m.cer"), "gpu_memory_mb": F.lit(None).cast("double"), "vad_segments": F.col("vad_segments").cast("int")})
    return rows.select(*STAGE_FIELDS, "error")


def baseline(results: DataFrame) -> DataFrame:
    """The baseline table with its real-time factor worked out again."""
    rtf = F.round(sg.rtf_or_zero(F.col("Inference Time (s)"), F.col("Duration (s)")), 3)
    return results.select("result_id", F.col("File").alias("file"), F.col("Detected Language").alias("language"), rtf.alias("rtf"), F.trim("Transcription").alias("text"))


def keyword_experiment(results: DataFrame, keywords: list[str], stages: list[str]) -> DataFrame:
    """Keyword hits of a file by stage."""
    hits = results.select("file", "stage", F.size(tx.keyword_hits(F.col("hypothesis"), keywords)).alias("hits"))
    return hits.groupBy("file").pivot("stage", stages).agg(F.min("hits"))


def filter_summary(results: DataFrame, allowed: list[str]) -> DataFrame:
    """Kept and rejected rows of a file by language; a missing label is the file's main language."""
    reason = segments.allowed_language(F.when(F.col("Detected Language") != "", F.col("Detected Language")), F.lit("hi"), allowed)
    return results.groupBy(F.col("File").alias("file")).agg(F.count_if(reason.isNull()).alias("kept"), F.count_if(reason.isNotNull()).alias("rejected"))
