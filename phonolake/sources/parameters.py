"""Parameters of a run, checked before any job starts."""

from __future__ import annotations

import argparse
from dataclasses import dataclass, fields

RATE = 16000


@dataclass(frozen=True)
class Run:
    """What the command line may say; validated on making."""

    data_dir: str = "data"
    file: str | None = None
    language: str = "hi"
    ground_truth: str = "data/gt.txt"
    output: str = "results"
    evaluate: bool = False
    model: str = "stub"
    stage: str = "all"
    decoder: str = "ctc"
    batch_size: int = 4
    chunk_seconds: float = 30.0
    overlap_seconds: float = 5.0
    lookahead_tokens: int = 13
    target_speaker: str = "longest"
    vad_threshold: float = 0.5
    min_speech_ms: int = 250
    min_silence_ms: int = 100
    speech_pad_ms: int = 30

    def __post_init__(self) -> None:
        if self.batch_size < 1:
            raise ValueError("batch size must be at least 1")
        if self.chunk_seconds <= 0:
            raise ValueError("chunk must be longer than 0")
        if not 0 <= self.overlap_seconds < self.chunk_seconds:
            raise ValueError("overlap must be at least 0 and shorter than the chunk")
        if self.lookahead_tokens not in (0, 3, 6, 13):
            raise ValueError("lookahead must be 0, 3, 6 or 13")
        if not 0 <= self.vad_threshold <= 1:
            raise ValueError("threshold must be between 0 and 1")
        if min(self.min_speech_ms, self.min_silence_ms, self.speech_pad_ms) < 0:
            raise ValueError("times must not be negative")

    @property
    def chunk_samples(self) -> int:
        return round(self.chunk_seconds * RATE)

    @property
    def overlap_samples(self) -> int:
        return round(self.overlap_seconds * RATE)


def parse(arguments: list[str]) -> Run:
    """A run from command-line words; each field is an option."""
    parser = argparse.ArgumentParser()
    for f in fields(Run):
        name = "--" + f.name.replace("_", "-")
        if f.type in (bool, "bool"):
            parser.add_argument(name, action="store_true")
        else:
            parser.add_argument(name, type={"int": int, "float": float}.get(str(f.type), str), default=f.default)
    return Run(**vars(parser.parse_args(arguments)))


def supported_rate(rate: int) -> int:
    """The rates that speech detection takes."""
    if rate not in (8000, 16000):
        raise ValueError("speech detection takes 8 or 16 kHz")
    return rate
