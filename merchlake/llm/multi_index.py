"""Embedding near-duplicates: an inverted multi-index with multi-sequence traversal, then verification.

Equal vectors are one node first, which counts as often as it occurs, so a vector that many rows share costs no more than another.

Two codebooks, one for each half of the normalised vectors, span a product grid of cells. A vector visits the cells nearest to it,
in the order of the multi-sequence traversal, and is compared in double precision with all vectors in them. A bounded sample fits
codebooks of several sizes. Their visits are the least that find TARGET of all the links of a bounded set of queries, by pair and as
the mean over queries; the queries are compared with every vector of the table, so their links do not thin out as it grows. Where few
queries have links, made-up ones at the threshold count too. The cheapest size is used; that of one cell is exact, so one always
reaches the target. Every vector is indexed and every vector searches. A pair counts once for each side, whichever of the two visits
the other's cell.

Vectors of different lengths never link. The commonest length and every other with more than FEW vectors has an index of its own; each of the rest
is one cell, which is exact. Cells with many vectors or visitors are dealt out in blocks, so no task holds more than BLOCK of either; links
are counted inside the blocks and never emitted as pairs. Vectors that are null, zero or hold null or non-finite components, and rows
without a key, link with nothing. Rows that repeat a key are vectors of their own; an empty table gives an empty table; extra columns do not matter.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_batch, forget, materialize
from .components import components

THRESHOLD = 0.9
#: Vectors that fit the codebooks and the number of cells to visit; vectors per cell, about; most entries of a codebook.
SAMPLE, PER_CELL, MOST_ENTRIES = 8192, 40, 2048
#: Vectors of the sample for each entry of a codebook, where SAMPLE is fewer. Vectors of a less common length that need no index.
PER_ENTRY, FEW = 16, 16_384
#: Share of the queries' links that the visited cells must hold, and the fewest and most cells.
TARGET, LEAST_VISITS, MOST_VISITS = 0.999, 3, 512
#: Queries that measure the visits; those with links that are enough, else so many made-up links; links of a query tried in one block.
QUERIES, ENOUGH, MADE_UP, TRIED = 2048, 100, 512, 4
#: What a visit costs besides comparisons, in comparisons.
VISIT_COST = 300
#: Vectors and visitors of a cell in one task.
BLOCK = 2048


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one in double precision; scaled first, so that tiny and huge components do not vanish."""
    x = vectors.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def k_means(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), size=k, replace=False)]
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(axis=1)[None, :], 0.0)


class Index(NamedTuple):
    halves: tuple[np.ndarray, np.ndarray]
    visits: int

    @property
    def size(self) -> int:
        return len(self.halves[0])

    def cells(self, x: np.ndarray, visits: int | None = None) -> np.ndarray:
        """The nearest cells of each row in order. In the multi-sequence traversal, the cell of the a-th and the b-th nearest
        entries follows the (a + 1)(b + 1) - 1 cells that are no farther, which bounds what can be among the first."""
        visits = min(visits or self.visits, self.size**2)
        parts = self._parts(x)
        order = [np.argsort(d, axis=1, kind="stable")[:, :visits] for d in parts]
        near = [np.take_along_axis(d, o, axis=1) for d, o in zip(parts, order, strict=True)]
        a, b = self._first(visits)
        sums = near[0][:, a] + near[1][:, b]
        first = np.argsort(sums, axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(order[0][:, a] * self.size + order[1][:, b], first, axis=1)

    def ranks(self, x: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """How many cells are nearer to each row than the given one; MOST_VISITS if that is beyond the visits."""
        parts = self._parts(x)
        rows = np.arange(len(x))
        own = parts[0][rows, cells // self.size] + parts[1][rows, cells % self.size]
        near = [np.sort(d, axis=1)[:, : self.visits] for d in parts]
        a, b = self._first(self.visits)
        nearer = (near[0][:, a] + near[1][:, b] < own[:, None]).sum(axis=1)
        return np.where(nearer < self.visits, nearer, MOST_VISITS)

    def pair_ranks(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each row of x and y, the rank at which one of them visits the other's cell; exact from LEAST_VISITS on."""
        out = np.zeros(len(x), dtype=np.int64)
        for at in range(0, len(x), 1024):
            p, q = x[at : at + 1024], y[at : at + 1024]
            found = self.ranks(p, self.cells(q, 1)[:, 0])
            late = np.flatnonzero(found >= LEAST_VISITS)
            if len(late):
                found[late] = np.minimum(found[late], self.ranks(q[late], self.cells(p[late], 1)[:, 0]))
            out[at : at + 1024] = found
        return out

    def _parts(self, x: np.ndarray) -> list[np.ndarray]:
        middle = len(self.halves[0][0])
        return [distances(part, book) for part, book in zip((x[:, :middle], x[:, middle:]), self.halves, strict=True)]

    def _first(self, visits: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = (i.ravel() for i in np.indices((min(visits, self.size),) * 2))
        may = (a + 1) * (b + 1) <= visits
        return a[may], b[may]


def entries(n: int) -> int:
    """Entries of a codebook that give about PER_CELL of n vectors to a cell."""
    return int(np.clip(np.sqrt(n / PER_CELL), 1, MOST_ENTRIES))


def fit(sample: np.ndarray, n: int) -> list[Index]:
    """Codebooks from a sample of unit vectors, for an index of n vectors: from about PER_CELL vectors in a cell to one cell."""
    k = min(entries(n), len(sample))
    middle = max(1, sample.shape[1] // 2)
    out = []
    while k:
        out.append(Index((k_means(sample[:, :middle], k, 1), k_means(sample[:, middle:], k, 2)), min(MOST_VISITS, k * k)))
        k //= 2
    return out


def made_up(x: np.ndarray, threshold: float) -> np.ndarray:
    """For each unit vector, another one at the threshold in a random direction."""
    off = np.random.default_rng(4).normal(size=x.shape)
    off -= np.einsum("ij,ij->i", off, x)[:, None] * x
    norm = np.sqrt(np.einsum("ij,ij->i", off, off))[:, None]
    return np.where(norm > 1e-9, threshold * x + np.sqrt(1 - threshold**2) * off / np.maximum(norm, 1e-9), x)


def measured(fine: DataFrame, indexes: list[Index], threshold: float) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each index, (query, rank, links) of the queries' links with all vectors."""
    drawn = fine.orderBy(F.xxhash64("node", F.lit(7)), "node").limit(QUERIES).select("node", "v").toArrow()
    queries, ids = unit(_vectors(drawn.column(1))), drawn.column(0).to_numpy()
    shared = fine.sparkSession.sparkContext.broadcast((queries, ids, indexes))

    def search(batch: pa.RecordBatch) -> dict:
        queries, ids, indexes = shared.value
        parts = []
        for at in range(0, batch.num_rows, 1024):
            x, own = unit(_vectors(batch.column(1).slice(at, 1024))), batch.column(0).slice(at, 1024).to_numpy()
            q, y = np.nonzero(queries @ x.T >= threshold)
            q, y = q[other := ids[q] != own[y]], y[other]
            if not len(q):
                continue
            _, first, n = np.unique(q, return_index=True, return_counts=True)
            tried = np.arange(len(q)) - np.repeat(first, n) < TRIED
            links = np.repeat(n / np.minimum(n, TRIED), n)[tried]
            q, y = q[tried], y[tried]
            parts += [(np.full(len(q), i), q, index.pair_ranks(queries[q], x[y]), links) for i, index in enumerate(indexes)]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0)] * 4
        return {name: c.astype(t) for name, c, t in zip(("i", "q", "rank", "links"), columns, ("i4", "i4", "i4", "f8"), strict=True)}

    found = by_batch(fine.select("node", "v"), search, "i int, q int, rank int, links double").groupBy("i", "q", "rank").agg(F.sum("links").alias("links")).toArrow()
    i, q, rank, links = (c.to_numpy() for c in found.columns)
    out = [(q[i == k], rank[i == k], links[i == k]) for k in range(len(indexes))]
    if len(np.unique(q)) < ENOUGH:
        x = queries[:MADE_UP]
        y = made_up(x, threshold)
        more = np.arange(len(x)) + QUERIES
        out = [tuple(np.concatenate(c) for c in zip(own, (more, index.pair_ranks(x, y), np.ones(len(x))), strict=True)) for own, index in zip(out, indexes, strict=True)]
    return out


def needed(q: np.ndarray, rank: np.ndarray, links: np.ndarray) -> int:
    """The visits that find TARGET of the links, by pair and as the mean over queries; more than MOST_VISITS if those do not."""
    _, at = np.unique(q, return_inverse=True)
    by_query = links / np.bincount(at, links)[at]
    shares = [np.bincount(rank, w, MOST_VISITS + 1) for w in (links / links.sum(), by_query / by_query.sum())]
    return 1 + max(int(np.argmax(np.cumsum(share) >= TARGET - 1e-12)) for share in shares)


def choose(indexes: list[Index], found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> Index:
    """The index that reaches TARGET with the least work."""
    best = []
    for index, own in zip(indexes, found, strict=True):
        visits = max(needed(*own), min(LEAST_VISITS, index.size**2))
        per_cell = n / index.size**2
        if visits <= index.visits:
            best.append((visits * (VISIT_COST * np.ceil(per_cell / BLOCK) + per_cell), -index.size, index._replace(visits=visits)))
    return min(best, key=lambda x: x[:2])[2]


def _vectors(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Side(NamedTuple):
    """Vectors of a block with their nodes and how often each occurs."""

    x: np.ndarray
    node: np.ndarray
    times: np.ndarray


def _found(q: Side, home: np.ndarray, b: Side, visits: np.ndarray, threshold: float) -> tuple:
    """(node, links, mate) of a block: counts for both sides, and each linked vector's least connected node in the block. home is where the
    seeking vectors are, visits the cells that those sought visit themselves."""
    link = (unit(q.x) @ unit(b.x).T >= threshold) & (q.node[:, None] != b.node[None, :])
    n_q, n_b = link @ b.times, np.zeros(len(b.node), dtype=np.int64)
    for c in np.unique(home):
        blind = ~(visits == c).any(axis=1)  # these do not visit the cell of the vector that has found them
        if blind.any():
            n_b += np.where(blind, q.times[home == c] @ link[home == c], 0)
    some_q, some_b = link.any(axis=1), link.any(axis=0)
    mate_q, mate_b, link = q.node[some_q].copy(), b.node[some_b].copy(), link[np.ix_(some_q, some_b)]
    high = np.iinfo(np.int64).max
    while len(mate_q):
        new_q = np.minimum(mate_q, np.where(link, mate_b[None, :], high).min(axis=1))
        new_b = np.minimum(mate_b, np.where(link, new_q[:, None], high).min(axis=0))
        if (new_q == mate_q).all() and (new_b == mate_b).all():
            break
        mate_q, mate_b = new_q, new_b
    return np.concatenate((q.node[some_q], b.node[some_b])), np.concatenate((n_q[some_q], n_b[some_b])), np.concatenate((mate_q, mate_b))


def usable(vector: str) -> Column:
    """Whether a vector can link: all finite, not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda v: v != 0), F.lit(False))


def learn(vectors: DataFrame, threshold: float) -> dict[int, Index]:
    """The index of each length that has one; vectors has node and v."""
    sizes = {r["length"]: r["count"] for r in vectors.groupBy(F.size("v").alias("length")).count().collect()}
    out = {}
    for length, n in sizes.items():
        if n > FEW or n == max(sizes.values()):
            fine = vectors.where(F.size("v") == length)
            sample = fine.orderBy(F.xxhash64("node"), "node").limit(max(SAMPLE, PER_ENTRY * entries(n))).select("v").toArrow().column(0)
            indexes = fit(unit(_vectors(sample)), n)
            out[length] = choose(indexes, measured(fine, indexes, threshold), n)
    return out


def _placed(vectors: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """vectors with the cell that each is in and those that it visits; cells of different lengths have different numbers."""
    shared = vectors.sparkSession.sparkContext.broadcast(indexes)

    def place(batch: pa.RecordBatch) -> dict:
        column = batch.column(1)
        lengths = column.value_lengths().to_numpy()
        visits: list = [None] * len(lengths)
        for length in np.unique(lengths):
            index = shared.value.get(int(length))
            own = np.flatnonzero(lengths == length)
            for at in range(0, len(own), 1024):
                some = own[at : at + 1024]
                cells = index.cells(unit(_vectors(column.take(pa.array(some))))) if index else np.zeros((len(some), 1), dtype=np.int64)
                for i, row in zip(some, cells + (int(length) << 32), strict=True):
                    visits[i] = row
        return {"node": batch.column(0), "v": column, "times": batch.column(2), "cell": [x[0] for x in visits], "visits": visits}

    return by_batch(vectors.select("node", "v", "times"), place, f"node bigint, v {dict(vectors.dtypes)['v']}, times bigint, cell bigint, visits array<bigint>")


def near_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept) of every row."""
    kind = dict(df.dtypes)[vector]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    zero = F.lit(0.0).cast(kind[6:-1])
    rows = df.select(F.col(key).alias("key"), F.col(key).cast("long").alias("id"), F.transform(F.col(vector).cast(kind), lambda x: x + zero).alias("v"))  # -0.0 is 0.0
    fine = usable("v") & F.col("id").isNotNull()
    digest = {"h": F.xxhash64("v"), "g": F.xxhash64(F.lit(1), "v")}
    vectors = rows.where(fine).groupBy("v").agg(F.min("id").alias("low"), F.count("*").alias("times")).withColumn("node", F.monotonically_increasing_id())
    vectors = materialize(vectors.withColumns(digest), "vectors")
    placed = materialize(_placed(vectors, learn(vectors, threshold)), "placed")
    visitors = placed.select("node", "v", "times", F.col("cell").alias("home"), F.explode("visits").alias("cell"))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n")).join(visitors.groupBy("cell").agg(F.count("*").alias("m")), "cell").select("cell", blocks("n").alias("nb"), blocks("m").alias("nq"))
    sizes = materialize(sizes, "cells")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    base = placed.join(sizes, "cell").select("cell", own("nb", 1).alias("b"), every("nq").alias("q"), F.lit(True).alias("base"), "node", "v", "times", F.col("cell").alias("home"), "visits")
    seek = visitors.join(sizes, "cell").select("cell", every("nb").alias("b"), own("nq", 2).alias("q"), F.lit(False).alias("base"), "node", "v", "times", "home", F.lit(None).cast("array<bigint>").alias("visits"))

    def compare(block: pa.Table) -> pa.Table:
        is_base = block.column("base").to_numpy()
        b, q = block.filter(pa.array(is_base)), block.filter(pa.array(~is_base))
        nodes = links = mates = np.zeros(0, dtype=np.int64)
        if b.num_rows and q.num_rows:
            side = lambda t: Side(_vectors(t.column("v")), t.column("node").to_numpy(), t.column("times").to_numpy())
            nodes, links, mates = _found(side(q), q.column("home").to_numpy(), side(b), _vectors(b.column("visits")), threshold)
        return pa.table({"node": nodes, "n": links, "mate": mates})

    found = materialize(base.unionByName(seek).groupBy("cell", "b", "q").applyInArrow(compare, "node bigint, n bigint, mate bigint"), "links")
    label = components(found.where("node <> mate").select(F.col("node").alias("a"), F.col("mate").alias("b")))
    each = vectors.select("node", "low", "times", "h", "g").join(found.groupBy("node").agg(F.sum("n").alias("n")), "node", "left").join(label, "node", "left")
    each = each.select("low", "h", "g", (F.coalesce("n", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = materialize(each.groupBy("component").agg(F.min("low").alias("component_id")), "least")
    # Written, so that the rows of one vector can be split in the join.
    each = materialize(each.join(least, "component").select("h", "g", "n_links", "component_id"), "each")
    forget(vectors, placed, sizes, found, label, least)
    named = rows.select("key", "id", *(F.when(fine, c).alias(f"own_{n}") for n, c in digest.items()))
    joined = named.join(each, (F.col("own_h") == F.col("h")) & (F.col("own_g") == F.col("g")), "left")
    component = F.coalesce("component_id", "id")
    return joined.select(F.col("key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def op7_embeddings(embeddings: DataFrame) -> DataFrame:
    """Every vector's number of links at a cosine of 0.9 or more, its component, and whether it stays."""
    return near_vectors(embeddings)


#: All pairs, and their components.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS v FROM embeddings),
u AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x : x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x : x <> 0)) > 0),
link AS (SELECT a.r AS x, b.r AS y FROM u a JOIN u b ON a.r <> b.r AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.9),
reach AS (SELECT r, r AS other FROM u UNION SELECT l.y, c.other FROM reach c JOIN link l ON l.x = c.r),
top AS (SELECT reach.r, min(u.vec_id) AS component_id FROM reach JOIN u ON u.r = other GROUP BY reach.r),
n AS (SELECT x AS r, count(*) AS n FROM link GROUP BY x)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(component_id, vec_id) IS NOT DISTINCT FROM vec_id AS kept
FROM e LEFT JOIN top USING (r) LEFT JOIN n USING (r)
"""
