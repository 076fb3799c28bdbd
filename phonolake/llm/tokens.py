"""Encoding of a corpus with a public byte-level tokenizer.

Method: speculate and verify. For each distinct word of a batch the greedy longest match
proposes tokens; one vectorised pass tests every adjacent pair of proposed tokens of all words
at once; only the words with a failing pair are merged exactly. A row of tokens is what the
merging gives exactly when each token and each adjacent pair is, so the result is exact.

Defined results: null and empty texts have an empty list of ids; text written like a special
token is ordinary text; blank and very long texts are encoded whole; repeated rows give
repeated results; columns other than the id and the text are not read.
"""

from __future__ import annotations

import ast
import base64
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZERS = "/opt/tokenizers"
NAME = "byte_bpe_50k"
#: Words of more bytes than this are not kept between batches.
KEEP_BYTES, KEEP_WORDS = 64, 200_000
FAR = np.int64(2**40)


def pattern(folder: str) -> str:
    """The public split pattern that goes with the vocabulary files."""
    line = next(x for x in (Path(folder) / "__init__.py").read_text().splitlines() if x.startswith("PATTERN"))
    return ast.literal_eval(line.partition("=")[2].strip())


class Encoder:
    """Ranks, splits and the tables of the pair test for one vocabulary."""

    def __init__(self, folder: str, name: str) -> None:
        import regex

        lines = (Path(folder) / f"{name}.tiktoken").read_bytes().splitlines()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        self.words = regex.compile(pattern(folder))
        size = max(self.ranks.values()) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        # how each token is made: the last merge of its bytes; a token that merging never gives isn't proposed
        self.made: dict[bytes, int] = {}
        pairs: dict[tuple[int, int], int] = {}
        for token, rank in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                self.made[token] = rank
                continue
            parts = self._merge(token, rank)
            if len(parts) == 2:
                self.left[rank], self.right[rank] = parts
                pairs[parts[0], parts[1]] = rank
                self.made[token] = rank
        # lengths of the tokens that begin with two bytes, longest first: the only ones that the longest match tries
        lengths: dict[bytes, set[int]] = {}
        for token in self.made:
            lengths.setdefault(token[:2], set()).add(len(token))
        self.lengths = {head: sorted(some, reverse=True) for head, some in lengths.items() if len(head) == 2}
        # merges as one sorted array of left * size + right
        self.size = size
        keys = np.array([a * size + b for a, b in pairs], np.int64)
        order = np.argsort(keys)
        self.keys, self.merged = keys[order], np.array(list(pairs.values()), np.int64)[order]
        # born: rank of the merge that makes a token; single bytes are there from the start
        self.born = np.arange(size, dtype=np.int64)
        self.born[self.left < 0] = -1
        self.kept: dict[str, list[int]] = {}

    def _merge(self, word: bytes, below: int | None = None) -> list[int]:
        """Exact merging: always the pair of lowest rank, the leftmost first."""
        parts = [word[i : i + 1] for i in range(len(word))]
        ranks = self.ranks
        if len(parts) > 200:
            return self._merge_long(word, below)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best) and (below is None or r < below):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _merge_long(self, word: bytes, below: int | None = None) -> list[int]:
        """The same by a heap over linked parts, for words of many bytes."""
        import heapq

        n, ranks = len(word), self.ranks
        end, prev, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap: list[tuple[int, int, int]] = []

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := ranks.get(word[i : end[j]])) is not None and (below is None or r < below):
                heapq.heappush(heap, (r, i, end[j]))

        for i in range(n - 1):
            push(i)
        while heap:
            _, i, e = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or end[j] != e:
                continue
            end[i], alive[j], after[i] = e, False, after[j]
            if after[j] < n:
                prev[after[j]] = i
            push(i)
            if prev[i] >= 0:
                push(prev[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = after[i]
        return out

    def _greedy(self, word: bytes) -> list[int]:
        out, at, n, made, lengths = [], 0, len(word), self.made, self.lengths
        while at < n:
            for size in lengths.get(word[at : at + 2], ()):
                r = made.get(word[at : at + size]) if at + size <= n else None
                if r is not None:
                    out.append(r)
                    at += size
                    break
            else:
                out.append(made[word[at : at + 1]])
                at += 1
        return out

    def _rank_of_pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], FAR)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes gives just the two.

        While a and b are made, the parts that touch at their border change: on the left the
        last parts of a, on the right the first parts of b, each from the merge that makes it
        to the merge that takes it up. The pair fails if two parts that touch at some time
        would be merged before either is taken up; of equal ranks the left merge comes first.
        """
        good = np.ones(len(a), bool)
        open_ = np.arange(len(a))
        x, y = a.copy(), b.copy()
        ends_x, ends_y = np.full(len(a), FAR), np.full(len(a), FAR)
        while len(open_):
            m = self._rank_of_pair(x, y)
            fails = (m < ends_x) & (m <= ends_y)
            good[open_[fails]] = False
            # go back in time: undo the later of the two merges
            undo_x = self.born[x] > self.born[y]
            more = ~fails & ((self.born[x] >= 0) | (self.born[y] >= 0))
            nx = np.where(undo_x, self.right[x], x)
            ny = np.where(undo_x, y, self.left[y])
            ends_x = np.where(undo_x, self.born[x], ends_x)
            ends_y = np.where(undo_x, ends_y, self.born[y])
            open_, x, y, ends_x, ends_y = open_[more], nx[more], ny[more], ends_x[more], ends_y[more]
        return good

    def encode_words(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of distinct words; proposals of all words are tested together."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        proposed = [[self.ranks[w]] if w in self.made else self._greedy(w) for w in raw]
        lengths = np.array([len(p) for p in proposed], np.int64)
        flat = np.fromiter((t for p in proposed for t in p), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        inside = owner[:-1] == owner[1:]
        pairs = np.unique(flat[:-1][inside] * self.size + flat[1:][inside])
        bad_pairs = pairs[~self.compatible(pairs // self.size, pairs % self.size)]
        keys = flat[:-1] * self.size + flat[1:]
        bad = np.unique(owner[:-1][inside & np.isin(keys, bad_pairs)])
        for i in bad:
            proposed[i] = self._merge(raw[i])
        return dict(zip(words, proposed, strict=True))

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.words.findall(t) if t else [] for t in texts]
        new = {w for row in split for w in row if w not in self.kept}
        fresh = self.encode_words(sorted(new)) if new else {}
        kept = self.kept
        out = []
        for row in split:
            ids: list[int] = []
            for w in row:
                ids += kept[w] if w in kept else fresh[w]
            out.append(ids)
        if len(kept) < KEEP_WORDS:
            kept.update((w, ids) for w, ids in fresh.items() if len(w) <= KEEP_BYTES)
        return out


@cache
def encoder(folder: str, name: str) -> Encoder:
    return Encoder(folder, name)


#: Characters of text that a worker splits at a time.
CHARS = 2_000_000


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``CHARS`` characters."""
    a = size = 0
    for b, t in enumerate(texts):
        size += len(t or "")
        if size >= CHARS:
            yield a, b + 1
            a, size = b + 1, 0
    if a < len(texts):
        yield a, len(texts)


def token_ids(df: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, only_count: bool = False) -> DataFrame:
    """The id and ``ids`` (integers) of each text; with ``only_count`` their number, ``n_tokens``, alone."""
    src = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = dict(src.dtypes)["doc_id"]

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(folder, name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in portions(texts):
                ids = e.encode(texts[a:b])
                result = pa.array([len(x) for x in ids], pa.int32()) if only_count else pa.array(ids, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), result], ["doc_id", "n_tokens" if only_count else "ids"])

    return src.mapInArrow(convert, f"doc_id {kind}, " + ("n_tokens int" if only_count else "ids array<int>"))
