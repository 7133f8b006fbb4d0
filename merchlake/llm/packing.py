"""Best-fit packing into sequences by a grouping genetic algorithm on islands.

Pieces of at most `capacity` tokens are dealt by hash of a row number into bounded groups, and each group is one bin-packing
problem. Several islands evolve packings of a group apart from each other, as separate rows of one table; after each
epoch every island hands its best packing to its neighbour through a shuffle. Crossover injects whole
well-filled bins of one parent into the other, drops the bins that hold duplicates, exchanges displaced pieces for smaller ones where that
fills a bin better, and best-fits the rest. A group whose packing meets the lower bound ceil(tokens / capacity) evolves no more.

Rounds follow: each group keeps its best-filled sequences and hands on the pieces of the worst-filled ones (at most one in RELEASED), which are
dealt into fewer groups and packed again, with a longer search, until all that is left is one group. So memory per task is bounded whatever
the input's size, and part-filled sequences do not add up with the groups.

Null text is an empty document of one token; rows that repeat in full are packed as they are, in different groups; an empty table gives an
empty table, and extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, groups_of, materialize, packed, unpacked
from .tokens import tokenizer_path, word_tokenizer

CAPACITY = 2048
END = 0
#: Pieces per group, islands per group, packings per island, epochs, and offspring per epoch.
GROUP, ISLANDS, POPULATION, EPOCHS, OFFSPRING = 2000, 2, 4, 2, 6
#: One in so many sequences, the worst-filled, is packed again in the next round, with so many times the offspring; sequences of a group, at
#: least, on average, so that pieces of one token do not make a group of less than a sequence.
RELEASED, LATER, LEAST_BINS = 8, 2, 64
#: Characters of texts that are tokenised together, about.
TOGETHER = 4 << 20


def best_fit(sizes: list[int], items: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> None:
    """Puts the items, largest first, where they leave the least room; opens bins as needed."""
    order = sorted((capacity - load, b) for b, load in enumerate(loads) if load < capacity)
    for i in sorted(items, key=lambda x: (-sizes[x], x)):
        at = bisect_left(order, (sizes[i], -1))
        if at < len(order):
            room, b = order.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
            loads.append(0)
        bins[b].append(i)
        loads[b] += sizes[i]
        if room > sizes[i]:
            insort(order, (room - sizes[i], b))


def lower_bound(sizes: list[int], capacity: int) -> int:
    return -(-sum(sizes) // capacity)


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square fill."""
    return -len(bins), sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(sizes: list[int], loose: list[int], capacity: int, bins: list[list[int]], loads: list[int]) -> list[int]:
    """Fills bins up by taking in a loose piece for one or two smaller ones, which become loose instead; returns what is loose then."""
    order = sorted((sizes[i], i) for i in loose)
    for b, own in enumerate(bins):
        room = capacity - loads[b]
        if not room or not order:
            continue
        best = (0, 0, ())
        for x, one in enumerate(own):
            for two in (None, *own[x + 1 :]):
                out = sizes[one] + (0 if two is None else sizes[two])
                at = bisect_left(order, (out + room + 1, -1)) - 1
                if at >= 0 and order[at][0] - out > best[0]:
                    best = (order[at][0] - out, at, (one,) if two is None else (one, two))
        if best[0]:
            gain, at, out = best
            own[:] = [i for i in own if i not in out] + [order.pop(at)[1]]
            loads[b] += gain
            for i in out:
                insort(order, (sizes[i], i))
    return [i for _, i in order]


def crossover(one: list[list[int]], two: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Injects well-filled bins of `two` into `one`; what the dropped bins of `one` held else is best-fitted."""
    fill = np.array([sum(sizes[i] for i in b) for b in two])
    full = np.argsort(-fill, kind="stable")[: max(1, len(two) * 2 // 3)]
    given = [two[b] for b in rng.choice(full, size=max(1, len(full) // 2), replace=False)]
    taken = {i for b in given for i in b}
    kept = [b for b in one if taken.isdisjoint(b)]
    loose = [i for b in one if not taken.isdisjoint(b) for i in b if i not in taken]
    bins = [list(b) for b in given] + [list(b) for b in kept]
    loads = [sum(sizes[i] for i in b) for b in bins]
    best_fit(sizes, exchange(sizes, loose, capacity, bins, loads), capacity, bins, loads)
    return bins


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """Empties the worst-filled bin and a few others, and best-fits what they held."""
    loads = [sum(sizes[i] for i in b) for b in bins]
    out = {int(np.argmin(loads)), *map(int, rng.integers(0, len(bins), size=3))}
    loose = [i for b in out for i in bins[b]]
    kept = [list(b) for n, b in enumerate(bins) if n not in out]
    left = [x for n, x in enumerate(loads) if n not in out]
    best_fit(sizes, exchange(sizes, loose, capacity, kept, left), capacity, kept, left)
    return kept


def first_packing(sizes: list[int], capacity: int, rng: np.random.Generator | None) -> list[list[int]]:
    """Best fit by decreasing size; with rng, after a random share of the pieces has been placed as it comes."""
    bins: list[list[int]] = []
    loads: list[int] = []
    items = list(range(len(sizes)))
    if rng is not None:
        early = [i for i in items if rng.random() < 0.3]
        for at in range(0, len(early), 50):
            best_fit(sizes, early[at : at + 50], capacity, bins, loads)
        items = sorted(set(items) - set(early))
    best_fit(sizes, items, capacity, bins, loads)
    return bins


def evolve(sizes: list[int], capacity: int, seed: int, visitors: list[list[list[int]]], offspring: int = OFFSPRING) -> list[list[int]]:
    """One epoch of an island: its best packing. `visitors` are its own last best and a neighbour's."""
    goal = lower_bound(sizes, capacity)
    rng = np.random.default_rng(seed)
    score = lambda b: fitness(b, sizes, capacity)
    people = [*visitors] or [first_packing(sizes, capacity, None)]
    best = max(people, key=score)
    if len(best) <= goal:
        return best
    while len(people) < POPULATION:
        people.append(first_packing(sizes, capacity, rng))
    for _ in range(offspring):
        a, b = rng.choice(len(people), size=2, replace=False)
        child = crossover(people[a], people[b], sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        worst = min(range(len(people)), key=lambda k: score(people[k]))
        if score(child) > score(people[worst]):
            people[worst] = child
        best = max(people, key=score)
        if len(best) <= goal:
            break
    return best


def pieces(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """A row per piece of each whole text: doc_id, piece, start, length and the CRC-32 of its ids."""
    path = path or tokenizer_path()

    def cut(batch: pa.RecordBatch) -> list:
        rows = []
        keys = batch.column(0).to_pylist()
        encoder = word_tokenizer(path)
        every = [x or "" for x in batch.column(1).to_pylist()]
        for part in groups_of(every, TOGETHER):
            for key, ids in zip(keys[part], encoder.encode(every[part]), strict=True):
                ids += END.to_bytes(4, "little")
                for n, start in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[start : start + 4 * capacity]
                    rows.append((key, n, start // 4, len(own) // 4, zlib.crc32(own)))
        return rows

    return by_batch(documents.select("doc_id", "text"), cut, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def to_bins(places: list[int]) -> list[list[int]]:
    out: dict[int, list[int]] = {}
    for i, b in enumerate(places):
        out.setdefault(int(b), []).append(i)
    return list(out.values())


def to_places(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for b, own in enumerate(bins):
        for i in own:
            out[i] = b
    return out


def _epoch(groups: DataFrame, elites: DataFrame | None, capacity: int, epoch: int, offspring: int) -> DataFrame:
    """One epoch of every island of every group: its best packing as the bin of each piece, and its fitness."""
    each = groups.select("grp", F.col("items.length").alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    met = F.lit(None).cast("array<array<int>>").alias("met")
    if elites is not None:
        travel = F.explode(F.array("island", (F.col("island") + 1) % ISLANDS)).alias("island")
        arrived = elites.select("grp", travel, "places", "fit").groupBy("grp", "island").agg(F.array_sort(F.collect_list(F.struct("fit", "places"))).alias("met"))
        each, met = each.join(arrived, ["grp", "island"]), F.col("met.places").alias("met")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for grp, island, sizes, met in zip(pdf.grp, pdf.island, pdf.sizes, pdf.met, strict=True):
                sizes = [int(x) for x in sizes]
                visitors = [to_bins(x) for x in met] if met is not None else []
                bins = evolve(sizes, capacity, (int(grp) * ISLANDS + int(island)) * EPOCHS + epoch, visitors, offspring)
                few, fill = fitness(bins, sizes, capacity)
                rows.append((grp, island, to_places(bins, len(sizes)), few + fill / 2))
            yield pd.DataFrame(rows, columns=["grp", "island", "places", "fit"])

    return each.select("grp", "island", "sizes", met).mapInPandas(run, "grp bigint, island int, places array<int>, fit double")


def settled(sizes: list[int], places: list[int], capacity: int, released: int) -> tuple[list[int], list[int]]:
    """Each piece's bin, or -1 if it is to be packed again, and its offset there. One in `released` bins goes, the worst-filled, none if 0."""
    loads: dict[int, int] = {}
    offsets = []
    for size, b in zip(sizes, places, strict=True):
        offsets.append(loads.get(b, 0))
        loads[b] = offsets[-1] + size
    most = -(-len(loads) // released) if released else 0
    again = {b for b in sorted(loads, key=lambda b: (loads[b], b))[:most] if loads[b] < capacity}
    return [-1 if b in again else b for b in places], offsets


def _packed(waiting: DataFrame, n_groups: int, capacity: int, step: int, released: int) -> DataFrame:
    """waiting (uid, length), packed in groups: uid, length, sequence_id (null if it is to be packed again) and offset."""
    grp = F.pmod(F.xxhash64("uid", F.lit(step)), F.lit(n_groups)).alias("grp")
    groups = waiting.select(grp, F.struct("length", "uid").alias("item")).groupBy("grp").agg(F.array_sort(F.collect_list("item")).alias("items"))
    elites = None
    for epoch in range(EPOCHS):
        elites = _epoch(groups, elites, capacity, epoch, OFFSPRING * (LATER if step else 1))
    best = elites.groupBy("grp").agg(F.max(F.struct("fit", "places")).alias("best"))
    rows = groups.join(best, "grp").select("grp", F.col("items.length").alias("sizes"), F.col("items.uid").alias("uids"), F.col("best.places").alias("places"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for grp, sizes, uids, places in zip(pdf.grp, pdf.sizes, pdf.uids, pdf.places, strict=True):
                bins, offsets = settled([int(x) for x in sizes], [int(x) for x in places], capacity, released)
                yield pd.DataFrame({"grp": grp, "uid": uids, "length": sizes, "bin": bins, "offset": offsets})

    number = (F.col("grp") * (1 << 24) + F.lit(step) * (1 << 20) + F.col("bin")).alias("sequence_id")
    return rows.mapInPandas(run, "grp bigint, uid bigint, length bigint, bin bigint, offset bigint").select("uid", "length", F.when(F.col("bin") >= 0, number).alias("sequence_id"), "offset")


def pack(items: DataFrame, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """items (any columns, with `length` from 1 to capacity) with sequence_id and offset."""
    numbered = materialize(packed(items, F.col("length").cast("bigint").alias("length"), F.monotonically_increasing_id().alias("uid")), "numbered")
    waiting, placed, step = numbered.select("length", "uid"), None, 0
    while True:
        n, tokens = waiting.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        n_groups = max(1, min(-(-n // group), tokens // (capacity * LEAST_BINS)))
        done = materialize(_packed(waiting, n_groups, capacity, step, RELEASED if n_groups > 1 else 0), "packed")
        kept = done.where("sequence_id IS NOT NULL").select("uid", "sequence_id", "offset")
        placed = kept if placed is None else placed.unionByName(kept)
        if n_groups == 1:
            break
        waiting, step = done.where("sequence_id IS NULL").select("length", "uid"), step + 1
    return unpacked(numbered.select("row", "uid").join(placed.withColumnRenamed("uid", "own"), F.col("uid") == F.col("own")), [c for c in items.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def op5_packing(documents: DataFrame) -> DataFrame:
    """Every document's tokens, in pieces of at most 2048, each with its sequence and its place there."""
    return pack(pieces(documents))
