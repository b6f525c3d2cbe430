"""Problem 9: documents into containers of fixed capacity.

Only the histogram of sizes reaches the driver. Combinations of up to three
sizes that fill a container are enumerated, non-negative least squares says how
often to use each, the rounded counts are subtracted, and what is left is
packed best-fit on the histogram. The plan is a list of slots, each a run of
equal containers; an item finds its own by its rank among the items of its
size, so the packing itself is one pass over the items.
"""

from __future__ import annotations

import bisect
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kvizmill.llm.encoding import document_sizes
from kvizmill.session import cut

#: Sizes are told apart in at most so many bins, rounded up.
BINS = 4096
#: Steps of the least squares at most, and the relative change of the repeat counts from which they are enough.
STEPS, STILL = 300, 0.005
#: Items of one size that are ranked together; a size with more is split into as many parts as it needs.
RANKED = 100_000


def bin_width(capacity: int) -> int:
    return max(1, -(-capacity // BINS))


def _combinations(counts: np.ndarray, window: int) -> np.ndarray:
    """All multisets of up to three occupied bins that fill the window; 0 pads."""
    sizes = np.flatnonzero(counts)
    out = []
    if counts[window]:
        out.append([[0, 0, window]])
    pairs = sizes[sizes * 2 <= window]
    rest = window - pairs
    ok = counts[rest] > 0
    out.append(np.stack([np.zeros(ok.sum(), int), pairs[ok], rest[ok]], axis=1))
    for a in sizes[sizes * 3 <= window]:
        b = sizes[(sizes >= a) & (sizes * 2 <= window - a)]
        c = window - a - b
        ok = counts[c] > 0
        out.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate([np.asarray(x, dtype=np.int64).reshape(-1, 3) for x in out]) if out else np.zeros((0, 3), np.int64)


def _least_squares(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts whose sizes come closest to the histogram (accelerated projected gradient)."""
    target = counts.astype(float)
    target[0] = 0
    # A column has norm at most 3; rows are scaled so that frequent sizes don't drown the rare ones.
    scale = 1 / np.sqrt(np.maximum(target, 1))
    goal = target * scale

    def apply(x):
        got = np.zeros(len(counts))
        for k in range(3):
            got += np.bincount(combos[:, k], weights=x, minlength=len(counts))
        got[0] = 0
        return got * scale

    def back(r):
        r = r * scale
        r[0] = 0
        return r[combos].sum(axis=1)

    v = np.ones(len(combos))
    for _ in range(12):  # the largest eigenvalue, for the step
        v = back(apply(v))
        norm = np.linalg.norm(v)
        v /= norm or 1
    step = 1 / max(norm * 1.05, 1e-12)
    x = y = np.zeros(len(combos))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0, y - step * back(apply(y) - goal))
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        y = new + (before - 1) / t * (new - x)
        moved, x = np.abs(new - x).sum(), new
        if moved < STILL * x.sum():
            break
    return x


def plan_packing(counts: np.ndarray, window: int) -> list[tuple[tuple[int, ...], int]]:
    """Runs of equal containers ``(sizes in bins, how many)`` that use up the histogram exactly.

    ``counts[s]`` items of ``s`` bins, s from 1 to window. Time and result
    depend on the number of bins, not of items.
    """
    left = counts.astype(np.int64).copy()
    left[0] = 0
    runs: list[tuple[tuple[int, ...], int]] = []
    combos = _combinations(left, window)
    if len(combos):
        repeats = np.rint(_least_squares(combos, left)).astype(np.int64)
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] <= 0:
                break
            parts = tuple(int(s) for s in combos[i] if s)
            each = defaultdict(int)
            for s in parts:
                each[s] += 1
            n = int(min(repeats[i], *(left[s] // m for s, m in each.items())))
            if n > 0:
                runs.append((parts, n))
                for s, m in each.items():
                    left[s] -= n * m
    # Best fit, largest first, on groups of equal open containers by the room they have left.
    room: dict[int, list[list]] = defaultdict(list)
    rooms: list[int] = []

    def put(space: int, parts: tuple[int, ...], n: int) -> None:
        if space not in room or not room[space]:
            bisect.insort(rooms, space)
        room[space].append([parts, n])

    for s in range(window, 0, -1):
        todo = int(left[s])
        while todo:
            at = bisect.bisect_left(rooms, s)
            if at == len(rooms):
                each = window // s  # open new ones, filled with this size at once
                full, rest = divmod(todo, each)
                if full:
                    put(window - each * s, (s,) * each, full)
                if rest:
                    put(window - rest * s, (s,) * rest, 1)
                break
            space = rooms[at]
            parts, n = room[space].pop()
            if not room[space]:
                rooms.pop(at)
            fit = space // s
            if todo >= fit * n:
                todo -= fit * n
                put(space - fit * s, parts + (s,) * fit, n)
            else:
                whole, rest = divmod(todo, fit)
                if whole:
                    put(space - fit * s, parts + (s,) * fit, whole)
                if rest:
                    put(space - rest * s, parts + (s,) * rest, 1)
                if n - whole - bool(rest):
                    put(space, parts, n - whole - bool(rest))
                todo = 0
    for groups in room.values():
        runs += [(parts, n) for parts, n in groups]
    return runs


class _Plan:
    """Slots of one capacity, sorted by size and first rank."""

    def __init__(self, counts: np.ndarray, window: int):
        runs = plan_packing(counts, window)
        taken: dict[int, int] = defaultdict(int)
        rows, base, self.run_base, self.run_items = [], 0, [], []
        for parts, n in runs:
            self.run_base.append(base)
            self.run_items.append(len(parts))
            for place, s in enumerate(parts):
                rows.append((s, taken[s], base, place))
                taken[s] += n
            base += n
        rows.sort()
        self.containers = base
        self.table = np.array(rows, dtype=np.int64).reshape(-1, 4)
        self.run_base = np.array(self.run_base, dtype=np.int64)
        self.run_items = np.array(self.run_items, dtype=np.int64)
        self.by_size = {s: slice(*np.searchsorted(self.table[:, 0], [s, s + 1])) for s in taken}

    def places(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        container, place = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
        for s in np.unique(size):
            mine = size == s
            if s == 0:  # takes no room: dealt out over the containers, after their other items
                n = max(1, self.containers)
                container[mine] = rank[mine] % n
                items = np.zeros(mine.sum(), np.int64)
                if self.containers:
                    items = self.run_items[np.searchsorted(self.run_base, container[mine], side="right") - 1]
                place[mine] = items + rank[mine] // n
                continue
            rows = self.table[self.by_size[s]]
            k = np.searchsorted(rows[:, 1], rank[mine], side="right") - 1
            container[mine] = rows[k, 2] + rank[mine] - rows[k, 1]
            place[mine] = rows[k, 3]
        return container, place


def _place(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    plans = shared.value
    for b in batches:
        limit, bins, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("limit_id", "bin", "rank"))
        container, place = np.zeros(len(limit), np.int64), np.zeros(len(limit), np.int64)
        for i in np.unique(limit):
            mine = limit == i
            container[mine], place[mine] = plans[i].places(bins[mine], rank[mine])
        yield pa.RecordBatch.from_arrays(
            [b.column("limit_id"), pa.array(container), pa.array(place + 1, pa.int32()), b.column("doc_id"), b.column("piece"), b.column("size")],
            names=["limit_id", "container", "place", "doc_id", "piece", "size"],
        )


def _ranked(items: DataFrame, counts: DataFrame) -> DataFrame:
    """``items`` with ``rank``, from 0, within their limit and bin.

    ``counts`` (limit_id, bin, count) has few rows. A bin is split by hash into
    parts of about RANKED items; a row's rank is its place in the part after
    the sizes of the parts before. Parts are counted, ranked and joined with
    what is before them on one partitioning, so items are shuffled once.
    """
    part = ["limit_id", "bin", "part"]
    of = counts.select("limit_id", "bin", F.ceil(F.col("count") / F.lit(RANKED)).cast("int").alias("parts"))
    split = items.join(F.broadcast(of), ["limit_id", "bin"]).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), "parts").cast("int"))
    sizes = split.groupBy(*part).agg(F.count("*").alias("n"))
    before = Window.partitionBy("limit_id", "bin").orderBy("part")
    starts = sizes.select(*part, (F.sum("n").over(before) - F.col("n")).alias("start"))
    nth = F.row_number().over(Window.partitionBy(*part).orderBy("doc_id", "piece", "size"))
    return split.join(starts.hint("merge"), part).withColumn("rank", F.col("start") + nth - 1)


def pack(sizes: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, container, place, doc_id, piece, size`` for each document or piece and each limit.

    ``sizes`` has ``doc_id, size`` and ``limits`` has ``limit_id,
    capacity_tokens``; other columns are left behind. A document larger than
    the capacity is cut into full pieces, numbered from 1, and a rest; no other
    is cut. ``place`` counts from 1 in each container. A document of size 0, or
    of null or negative size, takes no room but has a place. Rows repeated in
    ``sizes`` are items of their own; a null ``doc_id`` is packed as any other.
    Limits that are null or below 1 are left out, as are repeated ``limit_id``s
    but for the smallest capacity.

    To the driver come counts by limit and bin, at most BINS + 1 for a limit,
    and the plan made of them goes to the tasks.
    """
    wanted = (
        limits.where((F.col("capacity_tokens") >= 1) & F.col("limit_id").isNotNull())
        .groupBy("limit_id")
        .agg(F.min("capacity_tokens").alias("capacity"))
        .collect()
    )
    spark = sizes.sparkSession
    out_schema = "limit_id int, container long, place int, doc_id long, piece int, size long"
    if not wanted:
        return spark.createDataFrame([], out_schema)
    capacity = {int(r.limit_id): int(r.capacity) for r in wanted}
    whole = sizes.select("doc_id", F.greatest(F.coalesce(F.col("size"), F.lit(0)), F.lit(0)).cast("long").alias("whole"))
    per_limit = []
    for i, c in capacity.items():
        pieces = F.greatest(F.lit(1), F.ceil(F.col("whole") / c).cast("int"))
        items = whole.select("doc_id", "whole", F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
        size = F.least(F.lit(c).cast("long"), F.col("whole") - (F.col("piece") - 1) * F.lit(c).cast("long"))
        # The window is rounded down and sizes are rounded up: what fits in bins fits in tokens. Where the capacity
        # is no multiple of the bin width, the largest sizes would have a bin beyond the window; like those of the
        # last bin they have a container each.
        window = c // bin_width(c)
        per_limit.append(
            items.select(F.lit(i).alias("limit_id"), "doc_id", "piece", size.alias("size")).withColumn(
                "bin", F.least(F.lit(window), F.ceil(F.col("size") / bin_width(c))).cast("int")
            )
        )
    items = per_limit[0]
    for more in per_limit[1:]:
        items = items.unionByName(more)
    found = items.groupBy("limit_id", "bin").count().collect()
    histogram = {i: np.zeros(c // bin_width(c) + 1, dtype=np.int64) for i, c in capacity.items()}
    for r in found:
        histogram[r.limit_id][r.bin] = r["count"]
    shared = spark.sparkContext.broadcast({i: _Plan(counts, len(counts) - 1) for i, counts in histogram.items()})
    counts = spark.createDataFrame([tuple(r) for r in found], "limit_id int, bin int, count long")
    return _ranked(items, counts).mapInArrow(lambda batches: _place(batches, shared), out_schema)


def pack_documents(docs: DataFrame, limits: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``pack`` with the sizes of the texts in tokens; they are counted once and kept."""
    return pack(cut(document_sizes(docs, vocabulary)), limits)
