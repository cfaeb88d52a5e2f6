"""Problem 8: filling containers of a fixed capacity with items of varying size.

Method: exact-complement hashing on the histogram of sizes. For each size, largest first, the gap it leaves is
looked up among the available single sizes, then pair sums, then triple sums; a combination that fills the gap
exactly is used as often as the counts of its members allow. What remains is placed best-fit, largest first, by
size and multiplicity. The plan depends on the histogram alone, which has at most ``capacity`` rows whatever the
number of items, so it is made on the driver; items then find their container by their rank within their size,
which is computed from per-bucket counts: a size of many items is split into as many buckets as its count asks for.

Cases: an item larger than the capacity is divided into full containers and a rest, which is packed like any
item; an item of size 0 (null or empty text) takes no room and is put in container 0; null ids are kept; repeated
rows are items of their own; ties are broken by id; an empty table gives an empty table.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clausemill.storage import stash

#: About so many items of one size are ranked in one window.
BUCKET_ROWS = 250_000
Pattern = tuple[int, ...]


def plan_patterns(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Containers as (sizes inside, how many containers look like this); uses every item once.

    ``histogram`` has sizes from 1 to ``capacity``.
    """
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in histogram.items():
        left[size] = n
    out: list[tuple[Pattern, int]] = []

    def use(pattern: Pattern) -> bool:
        need: dict[int, int] = defaultdict(int)
        for s in pattern:
            need[s] += 1
        times = min(int(left[s]) // k for s, k in need.items())
        if times <= 0:
            return False
        for s, k in need.items():
            left[s] -= times * k
        out.append((pattern, times))
        return True

    if left[capacity]:
        use((capacity,))
    for big in range(capacity - 1, 0, -1):
        if not left[big]:
            continue
        gap = capacity - big
        if gap <= capacity:
            use((big, gap))
        if left[big] and gap >= 2:
            a = np.arange(gap - 1, (gap - 1) // 2, -1)
            for x in a[(left[a] > 0) & (left[gap - a] > 0)].tolist():
                use((big, x, gap - x))
                if not left[big]:
                    break
        if left[big] and gap >= 3:
            have = np.flatnonzero(left[: gap - 1] > 0)
            for x in have[::-1].tolist():
                if not left[big]:
                    break
                if not left[x]:
                    continue
                rest = gap - x
                y = np.arange(min(x, rest - 1), (rest - 1) // 2, -1)
                for b in y[(left[y] > 0) & (left[rest - y] > 0)].tolist():
                    use((big, x, b, rest - b))
                    if not left[big] or not left[x]:
                        break
    # best fit of what no combination filled exactly: open containers by the room they still have
    open_by_room: dict[int, list[tuple[Pattern, int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room == 0:
            out.append((pattern, times))
            return
        if not open_by_room[room]:
            bisect.insort(rooms, room)
        open_by_room[room].append((pattern, times))

    for size in range(capacity, 0, -1):
        n = int(left[size])
        while n:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):
                per = capacity // size
                if n >= per:
                    put(capacity - per * size, (size,) * per, n // per)
                    n %= per
                else:
                    put(capacity - n * size, (size,) * n, 1)
                    n = 0
                continue
            room = rooms[at]
            pattern, times = open_by_room[room].pop()
            if not open_by_room[room]:
                rooms.pop(at)
            used = min(n, times)
            if used < times:
                put(room, pattern, times - used)
            put(room - size, (*pattern, size), used)
            n -= used
    for room in rooms:
        out.extend(open_by_room[room])
    return out


def slots(patterns: list[tuple[Pattern, int]], first: int = 1) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each size: first rank of every run of slots, and the container that rank goes to.

    Ranks within a run go to consecutive containers.
    """
    ranks: dict[int, list[int]] = defaultdict(list)
    to: dict[int, list[int]] = defaultdict(list)
    filled: dict[int, int] = defaultdict(int)
    container = first
    for pattern, times in patterns:
        for size in pattern:
            ranks[size].append(filled[size])
            to[size].append(container)
            filled[size] += times
        container += times
    return {s: (np.array(ranks[s], dtype=np.int64), np.array(to[s], dtype=np.int64)) for s in ranks}


def pack(items: DataFrame, id_col: str, size_col: str, capacity: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id, piece_no INT, start BIGINT, size INT, container_id BIGINT): the container of each item or piece.

    ``start`` is where the piece begins inside its item. Containers are numbered from 0.
    """
    base = items.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("long").alias("total"))
    pieces = base.select("id", F.posexplode(F.expr(f"case when total <= {capacity} then array(total) else transform(sequence(0L, (total - 1) div {capacity}), k -> least({capacity}L, total - k * {capacity})) end")).alias("piece_no", "size"))
    pieces = stash(pieces.select("id", "piece_no", F.col("size").cast("int").alias("size")), "items")
    # at most capacity rows
    histogram = {size: n for size, n in pieces.where("size > 0").groupBy("size").count().collect()}
    splits = pieces.sparkSession.createDataFrame([(s, -(-n // bucket_rows)) for s, n in histogram.items() if n > bucket_rows], "size int, splits long")
    pieces = pieces.join(F.broadcast(splits), "size", "left")  # at most capacity rows
    bucket = F.pmod(F.xxhash64("id", "piece_no"), F.coalesce("splits", F.lit(1))).cast("int")
    pieces = pieces.select("id", "piece_no", "size", bucket.alias("bucket"))
    # a row for each bucket_rows items of a size, at most capacity more
    counted = pieces.where("size > 0").groupBy("size", "bucket").count().collect()
    taken: dict[int, int] = defaultdict(int)
    by_bucket: dict[tuple[int, int], int] = {}
    for size, bucket_no, n in sorted(map(tuple, counted)):
        by_bucket[size, bucket_no] = taken[size]  # ranks that earlier buckets of this size take
        taken[size] += n
    where = slots(plan_patterns(histogram, capacity), first=0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("size").to_numpy(zero_copy_only=False)
            bucket = batch.column("bucket").to_numpy(zero_copy_only=False)
            rank = batch.column("within").to_numpy(zero_copy_only=False).astype(np.int64)
            container = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size[size > 0]).tolist():
                at = np.flatnonzero(size == s)
                base = np.array([by_bucket[s, b] for b in bucket[at].tolist()], dtype=np.int64)
                starts, to = where[s]
                full = rank[at] + base
                run = np.searchsorted(starts, full, side="right") - 1
                container[at] = to[run] + full - starts[run]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("piece_no"), pa.array(batch.column("piece_no").to_numpy(zero_copy_only=False).astype(np.int64) * capacity), batch.column("size"), pa.array(container)], names=["id", "piece_no", "start", "size", "container_id"])

    within = Window.partitionBy("size", "bucket").orderBy("id", "piece_no")
    some = pieces.where("size > 0").withColumn("within", F.row_number().over(within) - 1)
    none = pieces.where("size = 0").withColumn("within", F.lit(0))
    kind = pieces.schema["id"].dataType.simpleString()
    return some.unionByName(none).mapInArrow(assign, f"id {kind}, piece_no int, start bigint, size int, container_id bigint").withColumnRenamed("id", id_col)
