"""Named queries of the training-data operators over the test tables, and SQL where it can say the same."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.llm import canonical as p2
from phonolake.llm import garbled as p9
from phonolake.llm import language as p4
from phonolake.llm import packing as p8
from phonolake.llm import percentiles as p6
from phonolake.llm import pieces as p3
from phonolake.llm import repetition as p5
from phonolake.llm import sentences as p1
from phonolake.llm import tokens as p7
from phonolake.sources.tables import spread

TOKENIZERS = os.environ.get("PHONOLAKE_TOKENIZERS", p7.TOKENIZERS)
#: Labelled sentences that problems 4 and 5 take at most, of a table of fixed size (30 for each language and script); problems 1 and 9 count them all.
SAMPLES = 2000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    rows = table(spark, folder, "lang_samples").orderBy("sample_id").limit(SAMPLES).collect()
    return [(r["lang"], r["text"]) for r in rows if r["text"]]


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Tables with their id and their text: of problems 1, 2 and 5.
SPOKEN = [("examples", "example_id", "reference"), ("experiment_results", "result_id", "hypothesis"), ("transcription_results", "result_id", "Transcription")]


def texts(spark: SparkSession, folder: str, which: list[tuple[str, str, str]]) -> DataFrame:
    """src, row_id and text of the tables together."""
    return union([spread(table(spark, folder, t).select(F.lit(t).alias("src"), F.col(i).alias("row_id"), F.col(f"`{c}`").alias("text"))) for t, i, c in which])


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents").select("doc_id", "text"))


def transcriptions(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "transcription_results").select("result_id", "Transcription", "Detected Language", "Language Prob"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of references and hypotheses."""
    return p1.sentences(texts(spark, folder, SPOKEN[:2]), ["src", "row_id"], "text", p1.counted(table(spark, folder, "lang_samples")))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows whose text isn't in the consistent form."""
    return p2.canonical(texts(spark, folder, SPOKEN), ["src", "row_id"], "text", only_changed=True, with_text=False)


def p2_canonical(spark: SparkSession, folder: str) -> DataFrame:
    """The consistent form of every text."""
    return p2.canonical(texts(spark, folder, SPOKEN), ["src", "row_id"], "text").drop("text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of the jobs of more than 480 samples."""
    return p3.pieces(table(spark, folder, "chunk_jobs"), ["file_index", "chunk_index"], "audio", divisor=1, least=0, last=True)


def p3_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all jobs that hold samples, cut at landmarks of the rolling hash."""
    return p3.pieces(table(spark, folder, "chunk_jobs"), ["file_index", "chunk_index"], "audio", all_items=True)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Segments of the transcriptions whose label is missing, wrong or too little."""
    df = transcriptions(spark, folder)
    return p4.mislabelled(df, ["result_id"], "Transcription", "Detected Language", samples(spark, folder)).select("result_id", "seg_no", "lang")


def p4_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Every segment with its language and confidence beside the given label and probability."""
    df = transcriptions(spark, folder)
    given = df.withColumnsRenamed({"Detected Language": "given_language", "Language Prob": "given_prob"})
    told = p4.labelled_rows(df, "result_id", "Transcription", "Detected Language")
    # a probability above 1 is in per cent
    given = given.withColumn("given_prob", F.when(F.col("given_prob") > 1, F.col("given_prob") / 100).otherwise(F.col("given_prob")))
    return p4.segments(given, ["result_id"], "Transcription", samples(spark, folder), told, ["given_language", "given_prob"])


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Rows that say at least two fifths again."""
    return p5.repetition(texts(spark, folder, SPOKEN[1:]), ["src", "row_id"], "text", [t for _, t in samples(spark, folder)], found=True)


def p5_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated share and calibrated probability of every row."""
    return p5.repetition(texts(spark, folder, SPOKEN[1:]), ["src", "row_id"], "text", [t for _, t in samples(spark, folder)])


def p6_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    """Percentiles by stage, from the rows."""
    return rounded(p6.percentiles(p6.states(table(spark, folder, "experiment_results"), "stage", ["rtf_total", "wer"]), group="stage"))


def p6_by_days(spark: SparkSession, folder: str) -> DataFrame:
    """The same, put together from the states of separate days."""
    return rounded(p6.percentiles(p6.combine(p6.states(table(spark, folder, "experiment_results"), "stage", ["rtf_total", "wer"], "recorded_at")), group="stage"))


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.round("value", 9))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return p7.token_ids(documents(spark, folder), "doc_id", "text", TOKENIZERS)


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The container of every document, or of each piece of a long one."""
    counted = p7.token_ids(documents(spark, folder), "doc_id", "text", TOKENIZERS, only_count=True)
    return p8.pack(counted, "doc_id", "n_tokens").withColumnsRenamed({"start": "start_token", "size": "n_tokens"})


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with text from a wrong decoding."""
    return p9.garbled(documents(spark, folder), p9.counted(table(spark, folder, "lang_samples"), "text"), with_text=False)


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    """These documents with their text restored where possible."""
    return p9.garbled(documents(spark, folder), p9.counted(table(spark, folder, "lang_samples"), "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p2_found, p2_canonical, p3_found, p3_pieces, p4_found, p4_segments, p5_found, p5_shares, p6_percentiles, p6_by_days, p7_ids, p8_containers, p9_found, p9_restored]
    return {f.__name__: f for f in names}


def _percentile_sql() -> str:
    parts = []
    for m in ("rtf_total", "wer"):
        for p in ("0.5", "0.9", "0.95", "0.99"):
            parts.append(f"SELECT '{m}' AS metric, stage, {p}::DOUBLE AS percentile, round(quantile_cont({m}, {p}), 9) AS value, count(*) AS n FROM experiment_results WHERE {m} IS NOT NULL AND NOT isnan({m}) GROUP BY stage")
    return " UNION ALL ".join(parts)


#: Cuts of problem 3 in SQL: pauses by gaps and islands, then a recursive walk over the cut points.
PIECES_SQL = """
WITH RECURSIVE jobs AS (
  SELECT file_index, chunk_index, any_value(audio) AS audio, any_value(len(audio)) AS n FROM chunk_jobs WHERE len(audio) > 480 GROUP BY file_index, chunk_index
), quiet AS (
  SELECT file_index, chunk_index, i - 1 AS i, i - row_number() OVER (PARTITION BY file_index, chunk_index ORDER BY i) AS island
  FROM (SELECT file_index, chunk_index, unnest(range(1, n + 1)) AS i, unnest(audio) AS x FROM jobs) WHERE abs(x) < 0.02::FLOAT
), cuts AS (
  SELECT file_index, chunk_index, list((a + b) // 2 ORDER BY a) AS cut FROM (
    SELECT file_index, chunk_index, island, min(i) AS a, max(i) + 1 AS b FROM quiet GROUP BY ALL HAVING count(*) >= 8) GROUP BY file_index, chunk_index
), walk AS (
  SELECT j.file_index, j.chunk_index, 0 AS piece_no, 0::BIGINT AS s, j.n, c.cut,
    CASE WHEN j.n <= 480 THEN j.n ELSE coalesce(list_max(list_filter(c.cut, lambda x: x > 16 AND x <= 480)), 480) END AS e
  FROM jobs j LEFT JOIN cuts c USING (file_index, chunk_index)
  UNION ALL
  SELECT file_index, chunk_index, piece_no + 1, e - 16, n, cut,
    CASE WHEN n - (e - 16) <= 480 THEN n ELSE coalesce(list_max(list_filter(cut, lambda x: x > e AND x <= e - 16 + 480)), e - 16 + 480) END
  FROM walk WHERE e < n
)
SELECT file_index, chunk_index, piece_no::INT AS piece_no, s::INT AS start_sample, e::INT AS end_sample FROM walk
"""


def oracle_sql() -> dict[str, str]:
    return {"p6_percentiles": _percentile_sql(), "p6_by_days": _percentile_sql(), "p3_found": PIECES_SQL}
