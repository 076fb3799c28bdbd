"""Recordings as tables: paths, contents, decoded samples."""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phonolake.functions import text as tx

# Suffixes of recordings.
SUFFIXES = [".wav", ".mp3", ".flac", ".m4a", ".ogg", ".aac"]


def files(spark: SparkSession, folder: str, recursive: bool = True, suffixes: list[str] | None = None) -> DataFrame:
    """path, length and content of the recordings, whatever the case of their suffix. Content is read only where it is used."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return found.select("path", "length", "content").filter(tx.suffix(F.col("path")).isin(suffixes or SUFFIXES))


def paths(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """Sorted paths alone."""
    return files(spark, folder, recursive).select("path").orderBy("path")


def decode_wave(content: bytes) -> tuple[np.ndarray, int]:
    """Frames by channels in -1..1, and the rate, of PCM of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        raw, width, channels, rate = w.readframes(w.getnframes()), w.getsampwidth(), w.getnchannels(), w.getframerate()
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] << 8 | b[:, 1] << 16 | b[:, 2] << 24) >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, np.int16 if width == 2 else np.int32).astype(np.float32) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels), rate


#: Decoders by suffix; others can be added.
DECODERS: dict[str, Callable[[bytes], tuple[np.ndarray, int]]] = {".wav": decode_wave}


def decoded(found: DataFrame, keep_channels: bool = False, decoders: dict | None = None) -> DataFrame:
    """path, sample_rate, n_channels, error and samples (the mean of the channels, or frames). A file that can't be decoded has its error and no samples."""
    known = DECODERS | (decoders or {})
    shape = "array<array<float>>" if keep_channels else "array<float>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    x, rate = known["." + path.rpartition(".")[2].lower()](content)
                    rows.append((path, rate, x.shape[1], None, [f.tolist() for f in x] if keep_channels else x.mean(axis=1)))
                except Exception as e:  # noqa: BLE001  (the row says what went wrong)
                    rows.append((path, None, None, f"{type(e).__name__}: {e}", None))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "n_channels", "error", "samples"])

    return found.select("path", "content").mapInPandas(run, f"path string, sample_rate int, n_channels int, error string, samples {shape}")
