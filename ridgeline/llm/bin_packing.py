"""Variable-capacity best-fit packing.

Documents have lengths (words, or any column of counts), and bins may have any
of several permitted capacities. Items are dealt to packing groups by hash and
each group is packed best fit decreasing:

* an item goes to the open bin with the least room that still holds it;
* if none does, a bin is opened whose capacity costs least a unit of what it is
  expected to hold, which is found by filling each permitted capacity with the
  items still to come, largest first. A bin of capacity c costs
  `BIN_COST` + c + c * c / `SQUARE_COST`: sequences cost their length, and
  attention its square, so a long bin has to be needed or be filled better;
* that choice looks at one bin at a time, so a group is packed once with each
  mix of permitted capacities that has the largest, and the mix of least total
  cost is taken;
* at the end each bin is cut down to the smallest permitted capacity that
  holds its contents.

Items over the largest capacity are split into full pieces and a rest, which
loses nothing.

Scale: a group has about `GROUP_ITEMS` items whatever the input, so a task's
memory is bounded and groups grow in number with the rows; only ids and lengths
are shuffled. Groups are dealt by id (rows without one by their number), so
copies and a hot source spread evenly. A group leaves at most one bin of each
capacity poorly filled, which is why groups are large.

Defined results: null and empty texts have length 0 and are placed in a bin
like any item (they take no room); rows that share an id are separate items;
rows with a null id are packed too; an empty table gives an empty result; extra
columns aren't used.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITIES = (512, 1024, 2048, 4096, 8192)
BIN_COST = 32
SQUARE_COST = 16384
LOOKAHEAD = 32
GROUP_ITEMS = 8192
PACKED = "doc_id long, piece int, piece_start long, length long, bin_group int, bin_id long, bin_offset long, bin_capacity int, bin_used long, n_pieces int"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def bin_cost_of(capacity: int, bin_cost: int = BIN_COST) -> float:
    return bin_cost + capacity + capacity * capacity / SQUARE_COST


def expected_fill(room: int, rising: list[int], totals: list[int], count: int) -> int:
    """What the first `count` of the rising lengths put into a room, the largest that fits first; after LOOKAHEAD items, all that there is."""
    filled = 0
    for _ in range(LOOKAHEAD):
        if totals[count] <= room - filled:
            return filled + totals[count]
        count = bisect_right(rising, room - filled, 0, count)
        if not count or not rising[count - 1]:
            return filled
        count -= 1
        filled += rising[count]
    return filled + min(room - filled, totals[count])


def opening_capacity(length: int, rising: list[int], totals: list[int], count: int, capacities: tuple[int, ...], bin_cost: int) -> int:
    """The permitted capacity of least cost a unit of what it is expected to hold: an item, and some of the `count` smaller ones."""
    fitting = [c for c in capacities if c >= length]
    return min(fitting, key=lambda c: (bin_cost_of(c, bin_cost) / max(1, length + expected_fill(c - length, rising, totals, count)), c))


def _pack_mix(lengths: np.ndarray, order: np.ndarray, rising: list[int], totals: list[int], capacities: tuple[int, ...], bin_cost: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    which, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    used: list[int] = []
    at_room: dict[int, list[int]] = {}  # room left: bins with it
    rooms: list[int] = []  # sorted, each once
    for done, item in enumerate(order.tolist()):
        length = int(lengths[item])
        place = bisect_left(rooms, length)
        if place < len(rooms):
            room = rooms[place]
            bins = at_room[room]
            chosen = bins.pop()
            if not bins:
                del at_room[room], rooms[place]
        else:
            chosen, room = len(used), opening_capacity(length, rising, totals, len(order) - done - 1, capacities, bin_cost)
            used.append(0)
        which[item], offset[item] = chosen, used[chosen]
        used[chosen] += length
        left = room - length
        if left not in at_room:
            at_room[left] = []
            insort(rooms, left)
        at_room[left].append(chosen)
    return which, offset, used


def pack(lengths: np.ndarray, capacities: tuple[int, ...] = CAPACITIES, bin_cost: int = BIN_COST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset of each item, capacity of each bin) for lengths up to the largest capacity."""
    capacities = tuple(sorted(capacities))
    order = np.lexsort((np.arange(len(lengths)), -lengths))
    rising = lengths[order][::-1].tolist()
    totals = [0, *np.cumsum(rising).tolist()]
    best = None
    for size in range(len(capacities)):
        for some in combinations(capacities[:-1], size):
            which, offset, used = _pack_mix(lengths, order, rising, totals, (*some, capacities[-1]), bin_cost)
            final = np.array([capacities[bisect_left(capacities, u)] for u in used], np.int64)
            cost = float(sum(bin_cost_of(int(c), bin_cost) for c in final))
            if best is None or cost < best[0]:
                best = cost, which, offset, final
    return best[1:]


def _pack_group(capacities: tuple[int, ...], bin_cost: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "length"], kind="stable", na_position="last").reset_index(drop=True)
        largest = max(capacities)
        whole = rows["length"].to_numpy(np.int64)
        pieces = np.maximum(1, -(-whole // largest))
        row = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        length = np.minimum(whole[row] - piece * largest, largest)
        which, offset, final = pack(length, capacities, bin_cost)
        used = np.bincount(which, weights=length, minlength=len(final)).astype(np.int64)
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].astype("Int64").take(row).array,
                "piece": piece.astype(np.int32),
                "piece_start": piece * largest,
                "length": length,
                "bin_group": np.full(len(row), key[0], np.int32),
                "bin_id": (np.int64(key[0]) << 32) + which,
                "bin_offset": offset,
                "bin_capacity": final[which].astype(np.int32),
                "bin_used": used[which],
                "n_pieces": pieces[row].astype(np.int32),
            }
        )

    return run


def pack_documents(
    docs: DataFrame,
    key: str = "doc_id",
    length: Column | None = None,
    capacities: tuple[int, ...] = CAPACITIES,
    bin_cost: int = BIN_COST,
    group_items: int = GROUP_ITEMS,
) -> DataFrame:
    """A row for each piece of each document, with its bin and place. length: words of `text` unless given."""
    items = docs.select(F.col(key).cast("long").alias("doc_id"), (word_count(F.col("text")) if length is None else length).cast("long").alias("length"))
    groups = max(1, round(docs.count() / group_items))
    if groups == 1:
        dealt = items.withColumn("_group", F.lit(0))
    else:
        place = F.coalesce("doc_id", F.monotonically_increasing_id())
        dealt = items.withColumn("_group", F.pmod(F.xxhash64(place, F.col("length")), F.lit(groups)).cast("int"))
    return dealt.groupBy("_group").applyInPandas(_pack_group(tuple(sorted(capacities)), bin_cost), PACKED)
