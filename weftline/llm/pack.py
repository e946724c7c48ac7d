"""Filling fixed-capacity containers with texts (problem 9): histogram packing with non-negative least squares."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.ranking import number_rows
from weftline.session import cut

#: Container capacity in tokens, and classes of length that the combinations are made of.
CAPACITY, CLASSES = 2048, 64


def combinations(classes: int, depth: int = 3) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` length classes whose sum is ``classes``: a full container when each length is
    rounded up to the end of its class. About classes ** 2 / 12 of them."""
    out = [(classes,)]
    if depth > 1:
        out += [(a, classes - a) for a in range((classes + 1) // 2, classes)]
    if depth > 2:
        for a in range(1, classes - 1):
            out += [(a, b, classes - a - b) for b in range(1, min(a, classes - a - 1) + 1) if 1 <= classes - a - b <= b]
    return out


def non_negative_least_squares(a: np.ndarray, b: np.ndarray, rounds: int = 1500) -> np.ndarray:
    """x >= 0 with a small |a x - b|, by accelerated projected gradients; a is small and dense."""
    x = np.zeros(a.shape[1])
    y, t = x.copy(), 1.0
    step = 1.0 / max(np.linalg.norm(a, 2) ** 2, 1e-12)
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * (a.T @ (a @ y - b)))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def plan_containers(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[tuple[int, ...], int]]:
    """[(sizes in one container, how many such containers)] that holds every item of the histogram exactly once.

    Works on counts, so its time depends on the capacity and not on the number of items. First the repeat counts of
    full combinations of classes are fitted to the histogram of classes by non-negative least squares, rounded down
    and filled with real sizes, largest first. What remains goes, largest first, into the fullest container that
    still takes it, or into new ones."""
    hist = {int(s): int(c) for s, c in histogram.items() if c > 0 and s > 0}
    if any(s > capacity for s in hist):
        raise ValueError("cut items above the capacity first")
    width = -(-capacity // classes)
    of = lambda s: -(-s // width)
    stock: dict[int, list[list[int]]] = defaultdict(list)
    for s in sorted(hist):
        stock[of(s)].append([s, hist[s]])  # the largest of a class last
    top = max(capacity // width, 1)  # whole classes only, so that a full combination never exceeds the capacity
    combos = combinations(top)
    target = np.array([sum(c for _, c in stock[k]) for k in range(1, top + 1)], float)
    done: dict[tuple[int, ...], int] = defaultdict(int)
    if target.sum() > 0:
        m = np.zeros((top, len(combos)))
        for j, c in enumerate(combos):
            for k in c:
                m[k - 1, j] += 1
        scale = target.max()
        repeats = np.floor(non_negative_least_squares(m, target / scale) * scale + 1e-6).astype(np.int64)
        for j in sorted(np.flatnonzero(repeats), key=lambda j: (-combos[j][0], -combos[j][-1])):
            _fill(combos[j], int(repeats[j]), stock, done, capacity)
    left = {s: c for runs in stock.values() for s, c in runs if c}
    _pack_rest(left, done, capacity)
    return sorted(done.items(), reverse=True)


def _fill(combo: tuple[int, ...], repeat: int, stock: dict, done: dict, capacity: int) -> None:
    """Realises one combination as often as planned and as its classes last, in runs of equal sizes."""
    need: dict[int, int] = defaultdict(int)
    for k in combo:
        need[k] += 1
    while repeat and all(sum(c for _, c in stock[k][-n:]) >= n for k, n in need.items()):
        sizes: list[int] = []
        run = repeat
        for k, n in need.items():
            s, c = stock[k][-1]
            if c >= n:  # all of the same size
                sizes += [s] * n
                run = min(run, c // n)
            else:  # the end of one size: one container takes what is left and then the next size
                run, want, i = 1, n, len(stock[k]) - 1
                while want:
                    take = min(want, stock[k][i][1])
                    sizes += [stock[k][i][0]] * take
                    want, i = want - take, i - 1
        for k in need:
            for s in set(sizes):
                for entry in stock[k]:
                    if entry[0] == s:
                        entry[1] -= run * sizes.count(s)
            stock[k] = [e for e in stock[k] if e[1]]
        done[tuple(sorted(sizes, reverse=True))] += run
        repeat -= run


def _pack_rest(left: dict[int, int], done: dict[tuple[int, ...], int], capacity: int) -> None:
    """Largest first into the container with the least room that is still enough; counts at a time."""
    rooms: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)
    for sizes, n in done.items():
        rooms[capacity - sum(sizes)][sizes] = n
    free = sorted(r for r in rooms if r > 0)
    done_now: dict[tuple[int, ...], int] = defaultdict(int)

    def add(sizes: tuple[int, ...], n: int) -> None:
        room = capacity - sum(sizes)
        if room not in rooms or not rooms[room]:
            if room > 0 and (i := bisect_left(free, room)) == len(free) or room > 0 and free[i] != room:
                insort(free, room)
        rooms[room][sizes] = rooms[room].get(sizes, 0) + n

    for s in sorted(left, reverse=True):
        c = left[s]
        while c:
            i = bisect_left(free, s)
            if i < len(free):
                room = free[i]
                sizes, n = next(iter(rooms[room].items()))
                fit = min(room // s, c)
                take = min(n, c // fit)
                del rooms[room][sizes]
                if n > take:
                    rooms[room][sizes] = n - take
                if not rooms[room]:
                    free.pop(i)
            else:
                sizes, fit = (), min(capacity // s, c)
                take = c // fit
            add(tuple(sorted(sizes + (s,) * fit, reverse=True)), take)
            c -= take * fit
    for by in rooms.values():
        for sizes, n in by.items():
            done_now[sizes] += n
    done.clear()
    done.update({k: v for k, v in done_now.items() if v})


def placements(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The plan as runs: sizes, first number among the items of that size, first container, offset in the container.
    Sorted by size and first number; the items of one run go to containers that follow each other."""
    used: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for sizes, n in plan:
        at = 0
        for s in sizes:
            rows.append((s, used[s], base, at))
            used[s] += n
            at += s
        base += n
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows) if rows else ([], [], [], [])))  # type: ignore[return-value]


def pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, size): items above the capacity cut into full pieces and a rest, others whole."""
    n = F.greatest(F.ceil(F.col("tokens") / F.lit(capacity)), F.lit(1)).cast("int")
    cut_up = sizes.withColumn("piece", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("piece").cast("bigint") * capacity
    return cut_up.select("doc_id", "_row", F.col("piece"), start.alias("start"), F.least(F.col("tokens") - start, F.lit(capacity)).cast("bigint").alias("size"))


def pack(sizes: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES) -> DataFrame:
    """(doc_id, piece, start, size, container_id, offset) of (doc_id, tokens) rows: every token of every row once.

    Only items above the capacity are cut; their full pieces fill a container each, the rest is packed like any item.
    Items of 0 tokens take no room and come out with a null container. Repeated rows are packed as often as they
    occur; an empty table gives no rows; null sizes count as 0.

    The driver sees the histogram of sizes, at most ``capacity`` rows whatever the data, and makes the plan from it.
    Items are numbered among those of their size, salted, so that a size with a third of all rows is no bottleneck,
    and each finds its container in the plan by its size and number: no join, no sort of all items."""
    spark = sizes.sparkSession
    ids = sizes.select("doc_id", F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("tokens"))
    # A number for every row, also for repeated ones; the checkpoint fixes it and saves a second tokenisation.
    base = cut(ids.withColumn("_row", F.monotonically_increasing_id()))
    items = pieces(base, capacity)
    full = items.where(F.col("size") > 0)
    histogram = {r["size"]: r["n"] for r in full.groupBy("size").agg(F.count("*").alias("n")).collect()}
    size, first, container, offset = placements(plan_containers(histogram, capacity, classes))
    shift = 1 << 44
    keys = size * shift + first
    kind = sizes.schema["doc_id"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s, n = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (3, 4))
            at = np.searchsorted(keys, s * shift + n, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:4], pa.array(container[at] + n - first[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "size", "container_id", "offset"],
            )

    schema = f"doc_id {kind}, piece int, start bigint, size bigint, container_id bigint, offset bigint"
    numbered = number_rows(full, ["size"], ["_row", "piece"], "number")
    placed = numbered.select("doc_id", "piece", "start", "size", "number").mapInArrow(place, schema)
    empty = items.where(F.col("size") == 0).select("doc_id", "piece", "start", "size", F.lit(None).cast("bigint").alias("container_id"), F.lit(None).cast("bigint").alias("offset"))
    return placed.unionByName(empty)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(containers, tokens, fill, over): how full the containers are, and how many hold more than the capacity."""
    per = packed.where(F.col("container_id").isNotNull()).groupBy("container_id").agg(F.sum("size").alias("t"))
    return per.agg(
        F.count("*").alias("containers"),
        F.coalesce(F.sum("t"), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.sum("t") / (F.count("*") * F.lit(capacity)), F.lit(1.0)), 6).alias("fill"),
        F.coalesce(F.sum((F.col("t") > capacity).cast("bigint")), F.lit(0)).alias("over"),
    )
