"""Filling fixed-capacity containers with texts of varying length.

The length histogram (at most one row per length up to the capacity) gives a configuration linear program: use as few
containers as possible so that every length is covered. It is solved by multiplicative weights: the price of a length
falls exponentially with its cover, knapsack dynamic programming finds the fillings that are most valuable at these
prices, and the prices give a lower bound at every step (what the histogram is worth over what one container can hold).
The solution is reduced to one filling a length, rounded down, and the few items left are filled largest first. Only
the histogram reaches the driver; the items are numbered and assigned on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Lengths are gathered into at most so many classes, each as long as its mean member, in the program.
CLASSES = 48
#: Accuracies that the program is solved to, one after the other, rounds for each, and the gap to the bound that is good
#: enough to stop.
ACCURACIES, ROUNDS, GAP = (0.3, 0.1, 0.03), 120, 0.002
#: Items numbered in one window group, about.
NUMBERED = 500_000


@dataclass(frozen=True)
class Filling:
    """A way to fill a container: how many items of which length, and how many containers are filled so."""

    items: tuple[tuple[int, int], ...]
    times: int


@dataclass(frozen=True)
class Program:
    """Solution of the configuration program: fillings (items per class, one row each) and how many containers take each
    (fractions), their sum, and a lower bound for any packing of the histogram."""

    classes: np.ndarray
    fillings: np.ndarray
    amounts: np.ndarray
    value: float
    bound: float


def best_values(lengths: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """For each room up to the capacity the value of the best filling (knapsack by dynamic programming) and the item that
    it takes first (-1: leaves a unit free). ``lengths`` rises."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    reach = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for room in range(int(lengths[0]), capacity + 1):
        best[room] = best[room - 1]
        worth = best[room - lengths[: reach[room]]] + values[: reach[room]]
        top = int(worth.argmax())
        if worth[top] > best[room] * (1 + 1e-12):
            best[room], choice[room] = worth[top], top
    return best, choice


def best_filling(lengths: np.ndarray, choice: np.ndarray, room: int) -> np.ndarray:
    counts = np.zeros(len(lengths), np.int64)
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= int(lengths[choice[room]])
    return counts


def size_classes(lengths: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Class of each length (``lengths`` rises): at most CLASSES runs of neighbouring lengths with about as many items."""
    if len(lengths) <= CLASSES:
        return np.arange(len(lengths))
    upto = np.cumsum(need) - need / 2
    return np.unique((upto * CLASSES / need.sum()).astype(np.int64), return_inverse=True)[1]


def solve_program(lengths: np.ndarray, need: np.ndarray, capacity: int) -> Program:
    """The configuration program by multiplicative weights. ``lengths`` rises; the work depends on the capacity only.

    Each round prices the classes, lists for every class the best filling that contains it, keeps those that are nearly
    as valuable as the best of all, and raises their amounts together, by as much as lets no class gain more than a
    small share of its need. The amounts, scaled so that the least covered class is covered, are a solution."""
    group = size_classes(lengths, need)
    wanted = np.bincount(group, need)
    size = np.maximum((np.bincount(group, need * lengths) / wanted).astype(np.int64), 1)
    bound, value, found, dual = float(lengths @ need) / capacity, np.inf, {}, (0.0, size / capacity)
    start = np.log(size / capacity)
    for accuracy in ACCURACIES:
        sharpness = np.log(len(size) + 1) / accuracy
        cover, amounts, total = np.zeros(len(size)), {}, 0.0
        for _ in range(ROUNDS):
            price = start - sharpness * (cover - cover.min())
            price = np.exp(price - price.max())
            best, choice = best_values(size, price, capacity)
            if (worth := float(wanted @ price) / best[capacity]) > dual[0]:
                dual = worth, price
            with_class = price + best[capacity - size]
            near = {}
            for c in np.flatnonzero(with_class >= (1 - accuracy) * best[capacity]):
                filling = best_filling(size, choice, capacity - int(size[c]))
                filling[c] += 1
                near[filling.tobytes()] = filling, with_class[c]
            rows = np.array([f for f, _ in near.values()])
            lag = np.array([w for _, w in near.values()]) / best[capacity] - 1
            step = np.array([(wanted[f > 0] / f[f > 0]).min() for f in rows]) * np.exp(lag / accuracy)
            gain = step @ rows / wanted
            step *= 1 / (sharpness * gain.max())
            for key, amount in zip(near, step.tolist(), strict=True):
                amounts[key] = amounts.get(key, 0.0) + amount
            cover += step @ rows / wanted
            total += step.sum()
            if cover.min() > 0 and total / cover.min() < value:
                value, found = total / cover.min(), {k: x / cover.min() for k, x in amounts.items()}
            if value <= dual[0] * (1 + GAP):
                break
        # Any prices of lengths bound the number of containers from below; these come from the best prices of classes.
        for of_length in (dual[1][group], dual[1][group] * lengths / size[group]):
            bound = max(bound, float(of_length @ need) / best_values(lengths, of_length, capacity)[0][capacity])
        if value <= dual[0] * (1 + GAP):
            break
        start = np.log(price)
    rows, amounts = few_fillings(np.array([np.frombuffer(k, np.int64) for k in found]), np.array(list(found.values())))
    return Program(size, rows, amounts, float(amounts.sum()), bound)


def few_fillings(rows: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same cover with at most as many fillings as there are classes and no more containers: among more fillings than
    classes some combination adds nothing; amounts are shifted along it, the way that does not cost, until one is 0."""
    order = np.argsort(amounts)
    rows, amounts = rows[order].astype(np.float64), amounts[order]
    classes = rows.shape[1]
    while len(amounts) > classes:
        head = slice(0, classes + 1)
        way = np.linalg.svd(rows[head].T)[2][-1]
        way = -way if way.sum() > 0 else way
        falling = way < -1e-12
        if not falling.any():
            break
        steps = np.where(falling, amounts[head] / np.where(falling, -way, 1.0), np.inf)
        gone = int(steps.argmin())
        amounts[head] = np.maximum(amounts[head] + steps[gone] * way, 0.0)
        rows, amounts = np.delete(rows, gone, axis=0), np.delete(amounts, gone)
    kept = amounts > 1e-9
    return np.rint(rows[kept]).astype(np.int64), amounts[kept]


def top_up(counts: np.ndarray, lengths_down: np.ndarray, left: np.ndarray, room: int) -> int:
    """Adds the largest items that fit, of those left. ``lengths_down`` falls; returns the room that remains."""
    at = 0
    while room > 0:
        at = max(at, int(np.searchsorted(-lengths_down, -room, "left")))
        while at < len(lengths_down) and left[at] <= counts[at]:
            at += 1
        if at >= len(lengths_down):
            break
        n = min(int(left[at] - counts[at]), room // int(lengths_down[at]))
        counts[at] += n
        room -= n * int(lengths_down[at])
        at += 1
    return room


def _largest_first(lengths_down: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    fillings = []
    while left.any():
        counts = np.zeros(len(left), np.int64)
        top_up(counts, lengths_down, left, capacity)
        used = counts > 0
        times = int((left[used] // counts[used]).min())
        left -= times * counts
        fillings.append((counts, times))
    return fillings


def _rounded(program: Program, lengths_down: np.ndarray, group: np.ndarray, left: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Fillings of whole containers after the program, largest amounts first. For each place of a filling the longest item
    left of its class is taken that still leaves room for the shortest ones of the places after it, then whatever else
    fits. ``left`` (items left) goes down."""
    members = [np.flatnonzero(group == c) for c in range(len(program.classes))]  # longest first
    fillings = []
    for row, amount in sorted(zip(program.fillings, program.amounts, strict=True), key=lambda x: (-x[1], x[0].tolist())):
        open_ = int(amount + 1e-9)
        places = [c for c in np.argsort(-program.classes) for _ in range(int(row[c]))]
        while open_ > 0:
            counts, room = np.zeros(len(left), np.int64), capacity
            held = [m[left[m] > 0] for m in members]
            least = [int(lengths_down[h[-1]]) if len(h) else 0 for h in held]
            after = sum(least[c] for c in places)
            for c in places:
                after -= least[c]
                fits = held[c][(lengths_down[held[c]] <= room - after) & (counts[held[c]] < left[held[c]])]
                if len(fits):
                    counts[fits[0]] += 1
                    room -= int(lengths_down[fits[0]])
            top_up(counts, lengths_down, left, room)
            used = counts > 0
            if not used.any():
                break
            times = min(open_, int((left[used] // counts[used]).min()))
            left -= times * counts
            open_ -= times
            fillings.append((counts, times))
    return fillings


def plan_fillings(histogram: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings that use up the histogram exactly: the rounded program, or largest first where that takes fewer."""
    lengths = np.array(sorted(s for s in histogram if 0 < s <= capacity), np.int64)
    if not len(lengths):
        return []
    need = np.array([histogram[int(s)] for s in lengths], np.int64)
    down, left = lengths[::-1], need[::-1].copy()
    program = solve_program(lengths, need.astype(np.float64), capacity)
    plans = [_rounded(program, down, size_classes(lengths, need.astype(np.float64))[::-1], left, capacity)]
    plans[0] += _largest_first(down, left, capacity)
    plans.append(_largest_first(down, need[::-1].copy(), capacity))
    best = min(plans, key=lambda plan: sum(n for _, n in plan))
    return [Filling(tuple((int(down[i]), int(p[i])) for i in np.flatnonzero(p)), n) for p, n in best]


def slots_by_length(fillings: list[Filling]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first item number, first container and items per container of each filling that takes it."""
    slots: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = {}
    container = 0
    for filling in fillings:
        for length, per in filling.items:
            slots.setdefault(length, []).append((taken.get(length, 0), container, per))
            taken[length] = taken.get(length, 0) + per * filling.times
        container += filling.times
    return {s: tuple(np.array(c, np.int64) for c in zip(*x, strict=True)) for s, x in slots.items()}


def item_pieces(sizes: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece_no, token_start, n_tokens): one piece per text, more only for texts above the capacity."""
    last = F.greatest(F.ceil(F.col(size) / capacity) - 1, F.lit(0))
    pieces = sizes.select(key, size, F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece_no"))
    start = F.col("piece_no") * capacity
    return pieces.select(key, F.col("piece_no").cast("int").alias("piece_no"), start.alias("token_start"), F.least(F.col(size) - start, F.lit(capacity)).alias("n_tokens"))


def length_histogram(pieces: DataFrame) -> dict[int, int]:
    """Pieces by length: at most capacity + 1 rows."""
    return {int(r["n_tokens"]): int(r["n"]) for r in pieces.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()}


def program_report(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """One row on how good the packing is: items, containers used, the value that the program was solved to, and the lower
    bounds for any packing from the program's prices and from the tokens alone. An empty table gives zeros."""
    histogram = length_histogram(item_pieces(sizes.where(F.col(size).isNotNull()).select(key, size), key, size, capacity))
    lengths = np.array(sorted(s for s in histogram if s > 0), np.int64)
    row = (sum(histogram.values()), 0, 0.0, 0, 0)
    if len(lengths):
        need = np.array([histogram[int(s)] for s in lengths], np.float64)
        program = solve_program(lengths, need, capacity)
        up = lambda x: int(np.ceil(x - 1e-6))
        row = (row[0], sum(f.times for f in plan_fillings(histogram, capacity)), round(program.value, 4), up(program.bound), up(float(lengths @ need) / capacity))
    return sizes.sparkSession.createDataFrame([row], "items bigint, containers bigint, program_value double, lower_bound bigint, volume_bound bigint")


def numbered_within_length(pieces: DataFrame, key: str, total: int) -> DataFrame:
    """Each piece's number within its length, from 0, without bringing a length into one task: pieces are numbered in
    hash buckets of a length, and each bucket starts where the earlier ones of its length end."""
    buckets = max(16, total // NUMBERED)
    spread = pieces.withColumn("bucket", F.pmod(F.xxhash64(key, "piece_no"), F.lit(buckets)).cast("int"))
    counted = spread.groupBy("n_tokens", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counted.select("n_tokens", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("n_tokens", "bucket").orderBy(key, "piece_no")
    return (
        spread.withColumn("at", F.row_number().over(inside) - 1)
        .join(offsets, ["n_tokens", "bucket"])
        .withColumn("item_no", F.col("offset") + F.col("at"))
        .drop("bucket", "offset", "at")
    )


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(key, piece_no, token_start, n_tokens, container_id): every text in a container, no container above capacity.

    Texts above the capacity are divided into full pieces and a rest, others never. Null sizes give no row; texts
    without tokens take no room and are put into container 0. Repeated keys are items of their own. An empty table
    gives an empty result. Which of several equally long items goes where is by hash and key, the same on every run.
    """
    pieces = cut(item_pieces(sizes.where(F.col(size).isNotNull()).select(key, size), key, size, capacity))
    histogram = length_histogram(pieces)
    slots = slots_by_length(plan_fillings(histogram, capacity))
    kind = pieces.schema[key].dataType.simpleString()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.zeros(len(batch), np.int64)
            for length, at in batch.groupby("n_tokens").indices.items():
                if length:
                    first, container, per = slots[int(length)]
                    no = batch["item_no"].to_numpy()[at]
                    row = np.searchsorted(first, no, "right") - 1
                    out[at] = container[row] + (no - first[row]) // per[row]
            yield batch.drop(columns="item_no").assign(container_id=out)

    numbered = numbered_within_length(pieces, key, sum(histogram.values())).select(key, "piece_no", "token_start", "n_tokens", "item_no")
    return numbered.mapInPandas(place, f"{key} {kind}, piece_no int, token_start bigint, n_tokens bigint, container_id bigint")
