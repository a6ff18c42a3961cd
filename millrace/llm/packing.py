"""Items packed into containers of fixed capacity, with certificates from dual-feasible functions.

Items are spread over partitions of bounded size. Each partition is packed by best-fit decreasing and compares its bin
count with the lower bound that dual-feasible functions give for its own items: where they are equal the partition is
certified. Partitions with a gap keep their full containers, give the rest back, and the documents given back by all of
them are exchanged over new partitions and packed again. When that saves nothing more, certified partitions give their
open containers back too, as long as the bound over all items says that containers may still be saved. A round counts
only if it saves some, and rounds go on until one saves nothing or the bound is met.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

CAPACITY = 4096
#: Items that one partition packs at once; bounds the memory of a task.
PARTITION_ITEMS = 20_000


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most containers that any of the dual-feasible functions proves necessary for ``sizes`` (1..capacity).

    Functions: the size itself; for each threshold t up to half the capacity, sizes above capacity - t count as full and
    sizes below t as nothing; for k = 1..100, the rounding-up of a size to k-ths of the capacity.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    return histogram_bound(count, capacity)


def histogram_bound(count: np.ndarray, capacity: int = CAPACITY) -> int:
    size = np.arange(capacity + 1, dtype=np.int64)
    number, weight = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * size)])
    t = np.arange(1, capacity // 2 + 1)
    by_threshold = capacity * (number[-1] - number[capacity - t + 1]) + weight[capacity - t + 1] - weight[t]
    best = max(int(weight[-1]), int(by_threshold.max(initial=0)))
    bound = -(-best // capacity)
    for k in range(1, 101):
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        # in units of capacity * k, so that integers suffice
        total = int((count * np.where(exact, size * k, scaled // capacity * capacity)).sum())
        bound = max(bound, -(-total // (capacity * k)))
    return bound


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """The container of each item, and each container's fill; ``sizes`` must fall. Of equally tight containers the latest."""
    where = np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    by_room: dict[int, list[int]] = defaultdict(list)
    rooms = 0  # bit r is set while a container has exactly r left
    for i, s in enumerate(sizes.tolist()):
        fitting = rooms >> s
        if fitting:
            room = s + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        fill[b] += s
        left = room - s
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
        where[i] = b
    return where, np.array(fill, np.int64)


def _pack_once(items: DataFrame, n: int, round_no: int, capacity: int, partition_items: int) -> DataFrame:
    """Items spread over partitions and packed: container, its fill, and whether the partition is certified."""
    parts = max(1, -(-n // partition_items))
    kind = items.schema["item_id"].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item_id", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pdf["size"].to_numpy(np.int64)
        where, fill = best_fit_decreasing(sizes, capacity)
        part = int(pdf["part"].iloc[0])
        return pd.DataFrame(
            {
                "item_id": pdf["item_id"].to_numpy(), "piece": pdf["piece"].to_numpy(), "size": sizes,
                "container": [f"r{round_no}-p{part}-c{b}" for b in where.tolist()],
                "fill": fill[where], "certified": len(fill) == lower_bound(sizes, capacity),
            }
        )

    spread = items.select("item_id", "piece", "size", F.pmod(F.xxhash64(F.lit(round_no), "item_id", "piece"), F.lit(parts)).alias("part"))
    return spread.groupBy("part").applyInPandas(pack, f"item_id {kind}, piece int, size int, container string, fill int, certified boolean")


def _containers(df: DataFrame) -> int:
    return df.select("container").distinct().count()


def pack(sizes: DataFrame, id_col: str = "doc_id", size_col: str = "n_tokens", capacity: int = CAPACITY, partition_items: int = PARTITION_ITEMS, rounds: int | None = None) -> DataFrame:
    """(id, piece, n_tokens, container) for every item with a positive size.

    An item within the capacity has one piece, number 0, in one container. A longer one is split: its pieces of full
    capacity have a container each, and its remainder is packed as an item of its own. Null, zero and negative sizes
    need no place and give no row; an empty table gives an empty table. ``id_col`` must be unique. ``rounds`` bounds the
    exchanges where less time matters more than containers.
    """
    items = sizes.select(F.col(id_col).alias("item_id"), F.col(size_col).cast("int").alias("size")).where("size > 0")
    full = F.floor(F.col("size") / capacity).cast("int")
    whole = items.where(full > 0).select("item_id", F.explode(F.sequence(F.lit(0), full - 1)).alias("piece"), F.lit(capacity).alias("size"))
    whole = whole.withColumn("container", F.concat_ws("-", F.lit("full"), F.col("item_id").cast("string"), F.col("piece").cast("string")))
    rest = cut(items.select("item_id", full.alias("piece"), (F.col("size") % capacity).alias("size")).where("size > 0"), "pack-items")
    columns = ["item_id", "piece", "size", "container"]
    final = [whole.select(columns)]
    n = rest.count()
    placed = cut(_pack_once(rest, n, 0, capacity, partition_items), "pack-0") if n else None
    bound = _remainder_bound(items, capacity) if n else 0
    used = _containers(placed) if n else 0
    everyone = False  # whether certified partitions take part too
    round_no = 0
    while placed is not None and used > bound and (rounds is None or round_no < rounds):
        round_no += 1
        part = F.col("fill") < capacity if everyone else ~F.col("certified") & (F.col("fill") < capacity)
        loose = placed.where(part)
        size = loose.agg(F.count(F.lit(1)).alias("items"), F.count_distinct("container").alias("containers")).first()
        again = cut(_pack_once(loose, size["items"], round_no, capacity, partition_items), f"pack-{round_no}") if size["items"] else None
        after = _containers(again) if again is not None else 0
        if again is None or after >= size.containers:
            if everyone:
                break  # the exchange saved nothing, so the former containers stand
            everyone = True
            continue
        # only full containers are done with; open ones of certified partitions may still take part
        full_now = F.col("fill") == capacity
        final.append(placed.where(full_now).select(columns))
        placed = again.unionByName(placed.where(~part & ~full_now))
        used += after - size.containers
        everyone = False
    if placed is not None:
        final.append(placed.select(columns))
    out = final[0]
    for df in final[1:]:
        out = out.unionByName(df)
    return out.select(F.col("item_id").alias(id_col), "piece", F.col("size").alias(size_col), "container")


def _remainder_bound(items: DataFrame, capacity: int) -> int:
    """The bound for the remainders of all items at once, from their counts by size: at most ``capacity`` rows."""
    count = np.zeros(capacity + 1, np.int64)
    for size, n in items.select((F.col("size") % capacity).cast("int").alias("size")).where("size > 0").groupBy("size").count().collect():
        count[size] = n
    return histogram_bound(count, capacity)


def certificate(sizes: DataFrame, packed: DataFrame, size_col: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: items, containers, the lower bound over all items at once, and the share of the space that is used.

    The bound comes from the counts of the remainders by size, at most ``capacity`` rows, plus one container for every
    full piece.
    """
    spark = sizes.sparkSession
    positive = sizes.where(F.col(size_col) > 0)
    head = positive.agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col(size_col) / capacity)).alias("full"), F.sum(F.col(size_col).cast("long")).alias("total")).first()
    bound = int(head.full or 0) + _remainder_bound(positive.select(F.col(size_col).alias("size")), capacity)
    used = _containers(packed)
    row = (int(head.n), used, bound, float(round((head.total or 0) / (used * capacity), 6)) if used else 0.0)
    return spark.createDataFrame([row], "n_items bigint, n_containers bigint, lower_bound bigint, fill double")
