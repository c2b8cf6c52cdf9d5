"""Best-fit packing of documents into sequences of several permitted lengths."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted sequence lengths and the cost of each: 64 for being a sequence at all, its slots, and
#: attention, which grows with the square and is as dear as the rest at 8192.
SIZES = (512, 1024, 2048, 4096, 8192)
COSTS = tuple(64 + size + size * size / 8192 for size in SIZES)
#: Pieces packed together; the last bins of so many pieces are all that stays unfilled.
WINDOW = 1 << 18


def best_fit(lengths: np.ndarray, sizes=SIZES, costs=COSTS) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(bin of each length, its offset there, size of each bin); lengths are 1 to the largest size.

    Longest first, each goes to the open bin with the least room that suffices
    (of equals, the one changed last). If none does, a bin is opened, of the size
    that is cheapest a slot filled: what the lengths that still wait would fill it
    with, longest first, counts, at the cost of the least size that holds as much;
    of equals the larger. In the end each bin is downsized to the cheapest size
    that holds its contents.

    Every single size that holds all lengths is packed for itself too, and the
    plan of least cost is taken, so the choice among sizes never costs more than
    the best of them alone.
    """
    order = np.argsort(-lengths, kind="stable").tolist()
    top = max(sizes)
    cheapest = [min((cost, size) for size, cost in zip(sizes, costs) if size >= n) for n in range(top + 1)]
    longest = int(lengths.max(initial=0))
    choices = [tuple(sizes), *((size,) for size in sorted(sizes) if size >= longest and len(sizes) > 1)]
    plans = [_plan(lengths, order, choice, cheapest) for choice in choices]
    bins, offsets, used = min(plans, key=lambda plan: sum(cheapest[n][0] for n in plan[2]))
    return bins, offsets, [cheapest[n][1] for n in used]


def _plan(lengths: np.ndarray, order: list[int], sizes: tuple[int, ...], cheapest: list[tuple[float, int]]):
    """(bin of each length, its offset, slots used of each bin) with bins of ``sizes``."""
    top = max(sizes)
    waiting = np.bincount(lengths, minlength=top + 1).tolist()
    some = 0  # bit n is set while a length n waits
    for n, count in enumerate(waiting):
        some |= (count > 0) << n

    def filled(room: int) -> int:
        """Slots that waiting lengths would take of ``room``, longest first."""
        left, least = room, room
        while fits := some & ((1 << (min(left, least) + 1)) - 1):
            n = fits.bit_length() - 1
            left -= min(waiting[n], left // n) * n
            least = n - 1
        return room - left

    def opened_for(n: int) -> int:
        asked = [n + filled(size - n) for size in sizes if size >= n]
        offers = zip(asked, (size for size in sizes if size >= n))
        return min((cheapest[held][0] / held, -size) for held, size in offers)[1] * -1

    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    used: list[int] = []
    with_room: list[list[int]] = [[] for _ in range(top + 1)]
    rooms = 0  # bit r is set while some bin has r slots left
    for i in order:
        n = int(lengths[i])
        waiting[n] -= 1
        if not waiting[n]:
            some ^= 1 << n
        if enough := rooms >> n:
            room = n + (enough & -enough).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                rooms ^= 1 << room
        else:
            at, room = len(used), opened_for(n) if len(sizes) > 1 else top
            used.append(0)
        bins[i], offsets[i] = at, used[at]
        used[at] += n
        if left := room - n:
            with_room[left].append(at)
            rooms |= 1 << left
    return bins, offsets, used


def _packer(sizes, costs, window):
    top = max(sizes)

    def packed(batches):
        base, made, held, size = TaskContext.get().partitionId() << 40, 0, [], 0

        def flush():
            nonlocal made
            ids = pa.concat_arrays([h[0] for h in held])
            piece, start, length = (np.concatenate([h[k] for h in held]) for k in (1, 2, 3))
            bins, offsets, capacity = best_fit(length, sizes, costs)
            columns = [ids, piece, start, length, bins + base + made, np.array(capacity, np.int64)[bins], offsets]
            made += len(capacity)
            return pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c) for c in columns],
                names=["id", "piece", "start", "n_tokens", "bin_id", "capacity", "bin_offset"],
            )

        for batch in batches:
            total = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            count = -(-total // top)
            row = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            length = np.minimum(top, total[row] - piece * top)
            ids = batch.column("id").take(pa.array(row))
            for a in range(0, len(row), window):
                part = slice(a, a + window)
                held.append((ids[part], piece[part], piece[part] * top, length[part]))
                size += len(held[-1][1])
                if size >= window:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return packed


def pack(
    docs: DataFrame, length: Column, id_col: str = "doc_id", sizes=SIZES, costs=COSTS, window: int = WINDOW
) -> DataFrame:
    """One row per piece: id, piece, start, n_tokens, bin_id, capacity, bin_offset.

    ``length`` is the number of slots of a row. Rows longer than the largest of
    ``sizes`` are cut into pieces of that size, in order; rows of NULL or no
    slots give no piece. Rows may repeat and ids may be NULL: each row is placed
    on its own.

    Nothing is shuffled. Each task packs the rows of its partition, ``window``
    pieces at a time, holding ids and lengths only, so no key and no count of
    copies makes a task larger. ``bin_id`` is unique over all partitions; which
    pieces share a bin follows from how the input is split into partitions.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), length.cast("long").alias("n")).filter("n > 0")
    schema = f"id {kind}, piece long, start long, n_tokens long, bin_id long, capacity long, bin_offset long"
    return rows.mapInArrow(_packer(tuple(sizes), tuple(costs), window), schema).withColumnRenamed("id", id_col)
