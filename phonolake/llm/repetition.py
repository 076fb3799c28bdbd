"""The share of a text that it has already said before.

Method: a text's hashed character and word n-grams are counted; the shares of them that come
again, and the share of letters that repeated ones cover, go into a logistic regression that is
trained on labelled rows and calibrated; rows are scored in Arrow batches, and a fixed threshold
of the probability alone decides. The labelled rows are made from labelled sentences, most of
them near the limit, and labelled by the plain measure, which ``repetition`` gives besides: the
characters in stretches of ``STRETCH`` or more that occur from an earlier place on.

Letter case, blanks and punctuation don't count, and text is put into its consistent form first.

Defined results: null, blank and mark-only texts have share 0 and no case; texts shorter than
two stretches have share 0; whole texts are read, however long; repeated rows give repeated
results; columns other than ids and text are not read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.canonical import canonical_array

STRETCH, SHARE = 10, 0.4
CHAR_ORDERS, WORD_ORDERS = (5, 10, 20), (1, 2, 3)
#: Calibrated probability from which a row is a case.
LIKELY = 0.5
#: Rows made for the training from the labelled sentences; characters of text that are worked on at a time.
TRAINING_ROWS, CHARS = 6000, 2_000_000
#: Scale of the cover beside the shares; penalty of the weights.
SCALE, PENALTY = 100.0, 1e-4
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
TOP = 0x30000


def looked_up(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Small letter of each code point, and whether it counts; above ``TOP`` stand the rarest Chinese letters, and below 40000 nothing else."""
    small, counts = letters()
    if not len(code) or code.max() < TOP:
        return small[code], counts[code]
    low = np.minimum(code, TOP - 1)
    return np.where(code < TOP, small[low], code), np.where(code < TOP, counts[low], code < 0x40000)


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """Code point: its small letter, and whether it counts (letter, digit or sign of a letter)."""
    small, counts = np.arange(TOP, dtype=np.uint32), np.zeros(TOP, bool)
    for c in range(TOP):
        x = chr(c)
        kind = unicodedata.category(x)[0]
        counts[c] = kind in "LNM" and not 0xFE00 <= c < 0xFE10
        if kind == "L" and len(low := x.casefold()) == 1:
            small[c] = ord(low)
    return small, counts


class Texts:
    """Some texts as one array of code points with the row and the word of each."""

    def __init__(self, texts: list[str | None]) -> None:
        joined = "\n".join(t or "" for t in texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(t or "") + 1 for t in texts), np.int64, len(texts))
        row = np.repeat(np.arange(len(texts)), lengths)[: len(code)]
        small, keep = looked_up(code)
        word = np.cumsum(~keep | (code >= 0x2E80))  # letters of scripts without blanks are words of their own
        self.n = len(texts)
        self.code, self.row, self.word = small[keep].astype(np.uint64), row[keep], word[keep]
        self.sizes = np.bincount(self.row, minlength=self.n)

    def again(self, hashed: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Which entries have come earlier in the same row.

        The high bits of the hash and the place are sorted as one number. Where two hashes share
        their high bits alone, which hardly happens, the whole hashes are sorted instead.
        """
        mixed = (hashed ^ ((row.astype(np.uint64) + np.uint64(1)) * MULTIPLIER)) * np.uint64(0xD6E8FEB86659FD93)
        out = np.zeros(len(mixed), bool)
        low = np.uint64((1 << max(1, len(mixed).bit_length())) - 1)
        key = (mixed & ~low) | np.arange(len(mixed), dtype=np.uint64)
        key.sort()
        at = (key & low).astype(np.int64)
        whole = mixed[at]
        same = whole[1:] == whole[:-1]
        if ((key[1:] ^ key[:-1]) <= low)[~same].any():
            at = np.argsort(mixed, kind="stable")
            same = mixed[at][1:] == mixed[at][:-1]
        out[at[1:]] = same
        return out

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of n characters, and which lie within one row."""
        count = len(self.code) - n + 1
        if count < 1:
            return np.empty(0, np.uint64), np.empty(0, bool)
        h = np.zeros(count, np.uint64)
        for k in range(n):
            h = (h ^ self.code[k : k + count]) * MULTIPLIER
            h ^= h >> np.uint64(29)
        return h, self.row[:count] == self.row[n - 1 : n - 1 + count]

    def covered(self, h: np.ndarray, inside: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row: the share of its runs of n characters that come again, and of its characters that these cover."""
        at = np.flatnonzero(inside)
        hits = at[self.again(h[at], self.row[at])]
        marks = np.zeros(len(self.code) + 1, np.int32)
        np.add.at(marks, hits, 1)
        np.add.at(marks, np.minimum(hits + n, len(self.code)), -1)
        cover = np.bincount(self.row[np.cumsum(marks[:-1]) > 0], minlength=self.n) / np.maximum(self.sizes, 1)
        return np.bincount(self.row[hits], minlength=self.n) / np.maximum(np.bincount(self.row[at], minlength=self.n), 1), cover

    def shares(self) -> np.ndarray:
        """Exact share of each row that lies in stretches said before."""
        return self.covered(*self.grams(STRETCH), STRETCH)[1] if len(self.code) else np.zeros(self.n)

    def features(self) -> np.ndarray:
        """Of each row: the shares of hashed n-grams that come again, by order, what those of ``STRETCH`` cover beyond the limit, and a constant."""
        columns, cover = [], np.zeros(self.n)
        for n in CHAR_ORDERS:
            h, inside = self.grams(n)
            if n == STRETCH:
                share, cover = self.covered(h, inside, n)
                columns.append(share)
            else:
                at = np.flatnonzero(inside)
                columns.append(self._share(h[at], self.row[at]))
        if len(self.code):
            first = np.flatnonzero(np.diff(self.word, prepend=-1) != 0)
            h = np.zeros(len(first), np.uint64)
            mixed = (self.code + np.uint64(1)) * MULTIPLIER
            place = (np.arange(len(self.code)) - np.repeat(first, np.diff(np.append(first, len(self.code))))).astype(np.uint64)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * (place * np.uint64(2) + np.uint64(1))
            h = np.add.reduceat(mixed, first)
            row = self.row[first]
        else:
            h, row = np.empty(0, np.uint64), np.empty(0, np.int64)
        for n in WORD_ORDERS:
            g, r = h, row
            for k in range(1, n):
                g = (g[:-1] * MULTIPLIER) ^ h[k:] if len(g) else g
            if n > 1 and len(row) >= n:
                inside = row[: len(row) - n + 1] == row[n - 1 :]
                g, r = g[inside], row[: len(row) - n + 1][inside]
            elif n > 1:
                g, r = np.empty(0, np.uint64), np.empty(0, np.int64)
            columns.append(self._share(g, r))
        return np.stack([*columns, (cover - SHARE) * SCALE, np.ones(self.n)], axis=1)

    def _share(self, h: np.ndarray, row: np.ndarray) -> np.ndarray:
        total = np.bincount(row, minlength=self.n)
        return np.bincount(row[self.again(h, row)], minlength=self.n) / np.maximum(total, 1)


def fit(x: np.ndarray, y: np.ndarray, steps: int = 30) -> np.ndarray:
    """Logistic regression by Newton steps, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (p * (1 - p))[:, None]).T @ x + PENALTY * np.eye(x.shape[1])
        w = w - np.linalg.solve(hess, x.T @ (p - y) + PENALTY * w)
    return w


def train(samples: list[str], rows: int = TRAINING_ROWS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Weights and calibration from rows made of the labelled sentences.

    A row strings sentences together and says a part of them again, as often as chance wants, or
    until about the limit is reached; its label is whether the share said again reaches the
    limit. Half of the rows fit the weights, the other half the calibration (slope and offset of
    the log-odds).
    """
    rng = np.random.default_rng(seed)
    samples = sorted(set(samples))
    made = []
    for _ in range(rows if samples else 0):
        parts = [samples[k] for k in rng.integers(0, len(samples), rng.integers(1, 6))]
        kind = rng.integers(0, 6)
        if kind == 1:
            parts += parts * int(rng.integers(1, 5))
        elif kind == 2:
            words = parts[0].split()
            a = int(rng.integers(0, len(words)))
            phrase = words[a : a + int(rng.integers(1, 5))]
            parts[0] = " ".join(words[:a] + phrase * int(rng.integers(1, 12)) + words[a:])
        elif kind == 3:
            parts += [parts[int(rng.integers(0, len(parts)))] for _ in range(int(rng.integers(1, 3)))]
        elif kind == 4:  # a short phrase that returns between new words
            words = " ".join(parts).split()
            a = int(rng.integers(0, len(words)))
            phrase, step = words[a : a + int(rng.integers(1, 4))], int(rng.integers(1, 5))
            parts = [w for k in range(0, len(words), step) for w in [*words[k : k + step], *phrase]]
        elif kind == 5:  # about the limit: the beginning again, of two thirds of what was said
            whole = " ".join(parts)
            parts = [whole, whole[: int(len(whole) * rng.uniform(0.5, 0.85))]]
        made.append(" ".join(parts))
    t = Texts(made)
    x, y = t.features(), (t.shares() >= SHARE).astype(float)
    w = fit(x[::2], y[::2])
    odds = np.stack([x[1::2] @ w, np.ones(len(x[1::2]))], axis=1)
    return w, fit(odds, y[1::2])


def probability(x: np.ndarray, model: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    w, (slope, offset) = model
    return 1 / (1 + np.exp(-np.clip((x @ w) * slope + offset, -30, 30)))


def repetition(df: DataFrame, ids: list[str], text: str, samples: list[str], found: bool = False) -> DataFrame:
    """Ids, repeated share and calibrated probability of each row; with ``found`` the ids of the cases alone."""
    model = train(samples)
    src = df.select(*[F.col(f"`{c}`") for c in ids], F.col(f"`{text}`").cast("string").alias("text"))
    if found:
        src = src.filter(F.length("text") > STRETCH)
    kinds = ", ".join(f"`{c}` {k}" for c, k in src.dtypes[: len(ids)])

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from phonolake.llm.tokens import portions

        for batch in batches:
            texts = canonical_array(batch.column(len(ids)))
            for a, b in portions(texts):
                t = Texts(texts[a:b])
                x = t.features()
                if found:
                    take = pa.array(a + np.flatnonzero(probability(x, model) >= LIKELY), pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(k).take(take) for k in range(len(ids))], ids)
                else:
                    yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(len(ids))), pa.array(t.shares()), pa.array(probability(x, model))], [*ids, "repeated_share", "probability"])

    return src.mapInArrow(convert, kinds + ("" if found else ", repeated_share double, probability double"))
