"""Filling containers of fixed capacity with items of varying size: matching of large items, then best fit of the small.

Sizes are whole numbers no larger than the capacity, so the whole problem is its *histogram*: how many items have each
size. The plan is made on that histogram - at most as many numbers as the capacity has tokens, whatever the corpus - with
runs of equal items placed into runs of equal containers at a time:

1. items above a third of the capacity are matched greedily, largest first with the largest partner that still fits, at
   most two to a container;
2. smaller items go by best fit, largest first, into the container with the least room that still takes them.

A text longer than a container is cut into full containers and a rest, which is an item like others. Each item then finds
its container from its rank among the items of its size. Ranks are counted by shards of each size, so that a size that
many items share is spread over many tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: About so many items are ranked in one task.
SHARD_ROWS = 50_000


class _Rooms:
    """Containers by the room left: runs (first container, how many) for each room."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.runs: dict[int, list[tuple[int, int]]] = {}

    def put(self, room: int, first: int, n: int) -> None:
        if n and room > 0:
            if room not in self.runs:
                self.runs[room] = []
                insort(self.rooms, room)
            self.runs[room].append((first, n))

    def take(self, least: int) -> tuple[int, int, int] | None:
        """A run with the least room that is at least ``least``: (room, first, n)."""
        i = bisect_left(self.rooms, least)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        first, n = self.runs[room].pop()
        if not self.runs[room]:
            del self.runs[room]
            self.rooms.pop(i)
        return room, first, n


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Rows (size, rank from, rank to, items a container, first container), and how many containers were opened."""
    left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
    used = dict.fromkeys(left, 0)
    steps: list[tuple[int, int, int, int, int]] = []
    rooms, opened = _Rooms(), 0

    def place(size: int, n: int, each: int, first: int) -> None:
        steps.append((size, used[size], used[size] + n, each, first))
        used[size] += n
        left[size] -= n

    large = sorted(s for s in left if 3 * s > capacity)  # the sizes that still have items
    for size in large[::-1]:
        while left[size]:
            i = bisect_left(large, capacity - size + 1) - 1  # the largest partner that fits
            if i < 0:
                n = left[size]
                place(size, n, 1, opened)
                rooms.put(capacity - size, opened, n)
            elif large[i] == size:
                n = left[size] // 2
                if not n:
                    place(size, 1, 1, opened)
                    rooms.put(capacity - size, opened, 1)
                    n = 1
                else:
                    place(size, 2 * n, 2, opened)
                    rooms.put(capacity - 2 * size, opened, n)
            else:
                n = min(left[size], left[large[i]])
                place(size, n, 1, opened)
                place(large[i], n, 1, opened)
                rooms.put(capacity - size - large[i], opened, n)
                if not left[large[i]]:
                    del large[i]
            opened += n
        i = bisect_left(large, size)
        if i < len(large) and large[i] == size:  # it may have gone as a partner
            del large[i]
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        while left[size]:
            found = rooms.take(size)
            if found is None:
                n = -(-left[size] // (capacity // size))
                found = capacity, opened, n
                opened += n
            room, first, n = found
            each = room // size
            full = min(n, left[size] // each)
            if full:
                place(size, full * each, each, first)
                rooms.put(room - each * size, first, full)
            if full < n:
                rest = min(left[size], each - 1) if left[size] < each else 0
                if rest:
                    place(size, rest, rest, first + full)
                    rooms.put(room - rest * size, first + full, 1)
                    full += 1
                rooms.put(room, first + full, n - full)
    return np.array(steps, dtype=np.int64).reshape(-1, 5), opened


def pack(items: DataFrame, capacity: int, item_id: str = "doc_id", size: str = "n_tokens", shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(``item_id``, piece_no, size, container_no): where each item, or each piece of an item above the capacity, goes.

    Every item comes out; repeated rows are items of their own. Items of size 0 or null take no room and are spread over
    the containers. Full pieces of long items fill containers of their own. An empty table gives no rows.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    kind = items.schema[item_id].dataType
    n = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    rows = items.select(F.col(item_id).alias("_id"), n.alias("_n")).withColumn("_rest", F.col("_n") % capacity).withColumn("_full", (F.col("_n") / capacity).cast("long"))
    total = rows.agg(F.count("*"), F.sum("_full")).first()
    shards = int(total[0] // shard_rows) + 1
    rows = rows.withColumn("_shard", F.pmod(F.xxhash64("_id"), F.lit(shards)))
    counts = rows.groupBy("_rest", "_shard").agg(F.count("*").alias("_c"), F.sum("_full").alias("_f"))
    # at most the capacity's number of sizes; the shards of each are summed up by the cluster
    histogram = {int(r[0]): int(r[1]) for r in counts.where("_rest > 0").groupBy("_rest").agg(F.sum("_c")).collect()}
    steps, opened = plan(histogram, capacity)
    steps = steps[np.lexsort((steps[:, 1], steps[:, 0]))]
    before = Window.partitionBy("_rest").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    # containers of full pieces follow those of the plan, counted on through the shards: first by thousands of them (one row
    # for fifty million items in the one task that sums these up), then within
    upto = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("_k").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_c").over(before), F.lit(0)))
    by_shard = counts.groupBy("_shard").agg(F.sum("_f").alias("_sf")).withColumn("_k", F.floor(F.col("_shard") / 1000))
    thousands = by_shard.groupBy("_k").agg(F.sum("_sf").alias("_tf")).withColumn("_tstart", F.coalesce(F.sum("_tf").over(upto), F.lit(0)))
    by_shard = by_shard.join(thousands, "_k").select("_shard", (F.col("_tstart") + F.coalesce(F.sum("_sf").over(within), F.lit(0))).alias("_fstart"))
    ranked = rows.join(starts.select("_rest", "_shard", "_start"), ["_rest", "_shard"])
    ranked = ranked.withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy("_rest", "_shard").orderBy("_id")) - 1).select("_id", "_n", "_rest", "_rank")
    containers = max(1, opened)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = steps[:, 0] * (1 << 40) + steps[:, 1]
        for b in batches:
            at = np.searchsorted(key, b["_rest"].to_numpy() * (1 << 40) + b["_rank"].to_numpy(), side="right") - 1
            s = steps[np.maximum(at, 0)] if len(steps) else np.zeros((len(b), 5), dtype=np.int64)
            box = s[:, 4] + (b["_rank"].to_numpy() - s[:, 1]) // np.maximum(s[:, 3], 1)
            box = np.where(b["_rest"].to_numpy() == 0, b["_rank"].to_numpy() % containers, box)
            yield pd.DataFrame({"_id": b["_id"], "piece_no": (b["_n"] // capacity + 1).astype("int32"), "size": b["_rest"].astype("int32"), "container_no": box + 1})

    out = T.StructType([T.StructField("_id", kind), T.StructField("piece_no", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("container_no", T.LongType())])
    rests = ranked.where((F.col("_rest") > 0) | (F.col("_n") == 0)).mapInPandas(place, out)
    if not total[1]:
        return rests.withColumnRenamed("_id", item_id)
    long_ = rows.where("_full > 0").join(by_shard, "_shard")
    run = Window.partitionBy("_shard").orderBy("_id", "_n").rowsBetween(Window.unboundedPreceding, -1)
    long_ = long_.withColumn("_at", F.col("_fstart") + F.coalesce(F.sum("_full").over(run), F.lit(0)))
    full = long_.select("_id", "_at", F.explode(F.sequence(F.lit(1), F.col("_full").cast("int"))).alias("piece_no"))
    full = full.select("_id", "piece_no", F.lit(capacity).alias("size"), (F.col("_at") + F.col("piece_no") + opened).alias("container_no"))
    return rests.unionByName(full).withColumnRenamed("_id", item_id)


def fill(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: n_items (different ids), n_containers, fill (share of the containers' room that is taken), n_over (containers
    that hold more than the capacity) and n_cut (items of no more than the capacity that are cut)."""
    item = packed.columns[0]
    boxes = packed.groupBy("container_no").agg(F.sum("size").alias("held")).agg(F.count("*").alias("n_containers"), F.round(F.sum("held") / (F.count("*") * capacity), 4).alias("fill"), F.sum((F.col("held") > capacity).cast("long")).alias("n_over"))
    items = packed.groupBy(item).agg(F.sum("size").alias("held"), F.count_distinct("piece_no").alias("pieces")).agg(F.count("*").alias("n_items"), F.sum(((F.col("held") <= capacity) & (F.col("pieces") > 1)).cast("long")).alias("n_cut"))
    return items.withColumn("one", F.lit(1)).join(boxes.withColumn("one", F.lit(1)), "one").drop("one")
