"""Speech segments: durations by speaker, islands from gaps, end of turn, confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phonolake.operators.ranks import runs

# Fixed values of the rules.
SILENCE, LOW_LOGPROB, HIGH_NO_SPEECH = 0.8, -0.8, 0.6
NO_LOGPROB, NO_NO_SPEECH = -99.0, 1.0
MISMATCH = "Language mismatch / potential hallucination"


def speaker_totals(turns: DataFrame, clip: str = "clip") -> DataFrame:
    """clip, speaker, seconds and first turn: sums of max(0, end - start). Needs clip, seg_idx, speaker, start, end."""
    return turns.groupBy(clip, "speaker").agg(F.sum(F.greatest(F.lit(0.0), F.col("end") - F.col("start"))).alias("seconds"), F.min("seg_idx").alias("first_idx"))


def longest_speaker(totals: DataFrame, clip: str = "clip") -> DataFrame:
    """The speaker of the longest total; of equal ones the first heard."""
    return totals.groupBy(clip).agg(F.max_by("speaker", F.struct("seconds", -F.col("first_idx"))).alias("speaker"), F.max("seconds").alias("seconds"))


def choose_speaker(durations: Column, target: str = "longest") -> Column:
    """From a map of durations; a named speaker must be there, an empty map gives null. Ties: the key that comes first."""
    if target != "longest":
        return F.when(F.size(durations) == 0, F.lit(None)).when(F.map_contains_key(durations, target), F.lit(target)).otherwise(F.raise_error(f"speaker {target} not found").cast("string"))
    entries = F.map_entries(durations)
    best = F.array_max(F.transform(entries, lambda e: e["value"]))
    return F.when(F.size(durations) > 0, F.element_at(F.transform(F.filter(entries, lambda e: e["value"] == best), lambda e: e["key"]), 1))


def islands(events: DataFrame, key: str, start: Column, end: Column, gap: float, least: float = 0.0, pad: float = 0.0) -> DataFrame:
    """Runs of events of a key that no silence longer than ``gap`` parts, of at least ``least``, padded and joined again.

    Gives key, start, end, n. A key that holds many of the events is spread over partitions.
    Rows without start or end are left out.
    """
    rows = events.select(F.col(key), start.alias("s"), end.alias("e"), F.lit(1).cast("bigint").alias("n")).filter(F.col("s").isNotNull() & F.col("e").isNotNull())
    done = runs(rows, key, gap).filter(F.col("end") - F.col("start") >= least)
    if not pad:
        return done
    return runs(done.select(key, (F.col("start") - pad).alias("s"), (F.col("end") + pad).alias("e"), "n"), key, 0.0)


def trailing_silence(duration: Column, last_end: Column) -> Column:
    """Silence after the last segment; the whole duration where there is none."""
    return F.greatest(F.lit(0.0), duration - F.coalesce(last_end, F.lit(0.0)))


def turn_finished(silence: Column, has_speech: Column) -> Column:
    """Long enough a silence, compared as it is; without speech a turn is over."""
    return F.when(~has_speech, F.lit(True)).otherwise(silence >= SILENCE)


def confidence(logprob: Column, no_speech: Column) -> list[Column]:
    """Aggregates: mean log-probability and highest no-speech probability, to three decimals, with the values for no segment."""
    return [F.coalesce(F.round(F.avg(logprob), 3), F.lit(NO_LOGPROB)).alias("avg_logprob"), F.coalesce(F.round(F.max(no_speech), 3), F.lit(NO_NO_SPEECH)).alias("no_speech_prob")]


def unsure(avg_logprob: Column, no_speech: Column | None = None) -> Column:
    """On the rounded values; by the log-probability alone where no second is given."""
    low = avg_logprob < LOW_LOGPROB
    return low if no_speech is None else low | (no_speech > HIGH_NO_SPEECH)


def allowed_language(segment: Column, clip: Column, allowed: list[str]) -> Column:
    """Reason why a segment is rejected, or null; a segment without language has its clip's."""
    return F.when(F.coalesce(segment, clip).isin(allowed), F.lit(None)).otherwise(F.lit(MISMATCH))


def top_classes(scores: DataFrame, clip: str, k: int) -> DataFrame:
    """The k classes of the highest mean score of each clip as one text. Needs clip, class_idx, class, score."""
    means = scores.groupBy(clip, "class_idx", "class").agg(F.avg("score").alias("mean"))
    ranked = means.withColumn("rank", F.row_number().over(Window.partitionBy(clip).orderBy(F.desc("mean"), F.desc("class_idx")))).filter(F.col("rank") <= k)
    shown = F.struct("rank", F.format_string("%s (%.2f)", F.col("class"), F.col("mean")).alias("shown"))
    return ranked.groupBy(clip).agg(F.array_join(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["shown"]), ", ").alias("classes"))
