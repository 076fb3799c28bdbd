"""Filling of containers of fixed capacity with items of varying size.

Method: bulk-synchronous best-fit. The items are range-sorted by size over all partitions, and
so are the gaps of the open containers; in each round all items of a size go at once to the
smallest gaps that hold them (a successor sweep over the sorted gaps), items and containers of
one size pair up by rank, which settles conflicts, the gaps are updated, and the next smaller
size follows; what finds no gap opens containers. Sizes and gaps are whole numbers up to the
capacity, so a round works on runs of containers with the same gap. These runs and the sweep
over them are held on the driver, from one count for each size: at most ``capacity`` rows,
whatever the data, and a capacity above ``SIZES`` is an error. The items take their places by
rank, where they lie.

Defined results: items without size (null or empty texts) are in no container; an item above
the capacity is split into pieces of the capacity and a rest, all others stay whole; ties are
ordered by id; rows with one id that are stored twice are two items; an empty table gives no
container.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.operators.ranks import sorted_parts, stored, with_position

CAPACITY = 2048
#: The greatest capacity: the plan has one row for each size on the driver, and a few places for each in the workers.
SIZES = 2**17


def plan(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Places (size, first rank, items a container, first container) and the number of containers.

    An item of rank r of a size is in container ``first + (r - first rank) // items`` of the
    last place of its size that starts at or before r.
    """
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: runs of containers (first, number)
    order: list[int] = []  # gaps in use, ascending
    places: list[tuple[int, int, int, int]] = []
    opened = 0

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(order, gap)
            gaps[gap].append((first, n))

    for size in sorted(counts, reverse=True):
        left, rank = counts[size], 0
        while left and (k := bisect.bisect_left(order, size)) < len(order):  # the successor of the size among the gaps
            gap = order[k]
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[k]
            fit = gap // size
            full = min(n, left // fit)
            if full:
                places.append((size, rank, fit, first))
                add(gap - fit * size, first, full)
                rank, left, first, n = rank + full * fit, left - full * fit, first + full, n - full
            if n and left and left < fit:
                places.append((size, rank, left, first))
                add(gap - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            add(gap, first, n)
        if left:
            fit = capacity // size
            full, rest = divmod(left, fit)
            places.append((size, rank, fit, opened))
            add(capacity - fit * size, opened, full)
            if rest:
                add(capacity - rest * size, opened + full, 1)
            opened += full + bool(rest)
    return places, opened


def pack(items: DataFrame, item_id: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """item id, piece_no, start, size and container_id of each item, or of each piece of one above the capacity."""
    if not 0 < capacity <= SIZES:
        raise ValueError(f"capacity {capacity} isn't between 1 and {SIZES}")
    cut = F.transform(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int")), lambda k: F.struct(k.alias("piece_no"), (k * capacity).alias("start"), F.least(F.col("n") - k * capacity, F.lit(capacity)).alias("size")))
    sized = items.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{size}`").cast("int").alias("n")).filter(F.col("n") > 0)
    pieces = stored(sized.select("item", F.explode(cut).alias("p")).select("item", "p.piece_no", "p.start", "p.size"))
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places, _ = plan(counts, capacity)
    sizes, ranks, fits, firsts = (np.array([p[k] for p in places], np.int64) for k in range(4))
    order = np.lexsort((ranks, sizes))
    sizes, ranks, fits, firsts = sizes[order], ranks[order], fits[order], firsts[order]
    reach = np.int64(2**48)
    keys = sizes * reach + ranks
    ranked = with_position(sorted_parts(pieces, ["size"], ["item", "piece_no"]), ["size"]).select("item", "piece_no", "start", "size", "position")
    kind = dict(ranked.dtypes)["item"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s, r = batch.column(3).to_numpy().astype(np.int64), batch.column(4).to_numpy()
            at = np.searchsorted(keys, s * reach + r, "right") - 1
            container = firsts[at] + (r - ranks[at]) // fits[at]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(container, pa.int64())], [item_id, "piece_no", "start", "size", "container_id"])

    return ranked.mapInArrow(place, f"`{item_id}` {kind}, piece_no int, start int, size int, container_id bigint")
