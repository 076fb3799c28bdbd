"""Sinks: JSON lines, nested JSON documents, CSV, wave files, console rows.

Every writer works on the executors; the nested documents collect aggregates or one run's
records into one value, as their format wants.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phonolake.operators.report import shown, with_index
from phonolake.sources.texts import RESULTS_CSV


def json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One object a row, letters as they are, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def evaluation(records: DataFrame, aggregates: DataFrame, metadata: dict[str, str]) -> DataFrame:
    """One document: run data, and for each slice its count, aggregate and records. Needs slice in both."""
    rows = records.groupBy("slice").agg(F.collect_list(F.struct(*[c for c in records.columns if c != "slice"])).alias("records"))
    each = aggregates.join(rows, "slice", "left").select("slice", F.struct(F.col("n").alias("count"), F.struct(*[c for c in aggregates.columns if c not in ("slice", "n")]).alias("aggregate"), F.coalesce("records", F.array().cast(rows.schema["records"].dataType)).alias("records")).alias("body"))
    return each.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("slice", "body")))).alias("slices")).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in metadata.items()], "slices"), {"ignoreNullFields": "false"}).alias("value"))


def results_document(df: DataFrame, order: str) -> DataFrame:
    """``{"results": [...]}`` of one run's rows, in an order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("__o"), F.struct("*").alias("r"))))
    return df.agg(F.transform(listed, lambda x: x["r"]).alias("results")).select(F.to_json(F.struct("results"), {"ignoreNullFields": "false"}).alias("value"))


def document_parts(df: DataFrame, order: str, path: str, mode: str = "errorifexists") -> None:
    """The same document of any number of rows, as text parts that give it when read in the order of their names.

    Rows are numbered over a range sort, and each writes its own line; no task sees all.
    """
    rows = with_index(df.select(F.col(order).alias("__o"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")), "__o", "value", name="__at")
    lines = rows.select("__at", F.concat(F.when(F.col("__at") > 0, ",").otherwise(""), "value").alias("value"))
    ends = df.sparkSession.createDataFrame([(-1, '{"results":['), (2**62, "]}")], "__at bigint, value string")
    lines.unionByName(ends).repartitionByRange("__at").sortWithinPartitions("__at").select("value").write.mode(mode).text(path)


def text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lines as they lie; parts are read in the order of their names."""
    df.write.mode(mode).text(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Cells with line breaks and quotes can be read again with the same options."""
    df.write.mode(mode).options(header=True, escape=RESULTS_CSV["escape"], quoteAll=False).csv(path)


def encode_wave(samples, rate: int) -> bytes:
    """PCM of 16 bits; values beyond -1..1 are cut."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(np.asarray(samples, np.float64), -1, 1) * 32767).round().astype("<i2").tobytes())
    return out.getvalue()


def waves(df: DataFrame, folder: str, name: Column, samples: str, rate: str) -> int:
    """A wave file for each row under a folder that the executors share; gives how many were written."""
    from pathlib import Path

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        Path(folder).mkdir(parents=True, exist_ok=True)
        for batch in batches:
            for n, x, r in zip(batch["name"], batch["samples"], batch["rate"], strict=True):
                part = Path(folder, f".{n}.part")
                part.write_bytes(encode_wave([] if x is None else x, int(r)))
                part.rename(Path(folder, n))  # a task that runs twice writes the same file
            yield pd.DataFrame({"n": [len(batch)]})

    done = df.select(name.alias("name"), F.col(samples).alias("samples"), F.col(rate).alias("rate")).mapInPandas(run, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def batch_names(prefix: str, index: Column) -> Column:
    """Names of a batch's files: prefix and five digits."""
    return F.format_string("%s_%05d.wav", F.lit(prefix), index)


def console(df: DataFrame) -> DataFrame:
    """Rows of the stage report: fixed widths, N/A for nothing."""
    cells = [F.rpad("stage", 35, " "), *[F.lpad(shown(F.col(c)), 10, " ") for c in ("wer", "cer", "rtf_total")]]
    return df.select(F.concat_ws(" ", *cells).alias("row"))
