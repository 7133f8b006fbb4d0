"""Substring dedup: suffix automata of reference shards, broadcast or dealt out, streamed for matching statistics.

A window is `WINDOW` consecutive words. Every window has an anchor, the K-gram of least hash in it, so equal windows share their
anchor wherever they start, and each window belongs to one anchor occurrence. An anchor occurrence with all windows that it owns is a
segment. Only anchors that occur twice or more can own a repeated window:

1. anchors are counted with partial aggregation;
2. the segments that occur most at the commonest anchors, BROADCAST at most, form the first reference shard. Its suffix automaton is
   broadcast, and every document is streamed through it: a window that it holds is repeated. K-grams that the shard does not hold are passed
   over without a step of the automaton. Segments in it take no further part, so copies of few texts never meet in a join;
3. of the other anchors, if all segments at one are equal, every window of them repeats: no automaton could say more;
4. otherwise the distinct segments of the anchor form a reference shard. Shards are split by hash once they pass SHARD segments. A suffix
   automaton of each shard with occurrence counts is built where its segments meet, and the segments are streamed through it: a
   window whose state counts two or more occurrences is repeated;
5. of the shards that were split, windows seen once are counted across shards by anchor and hash;
6. covered words go back to the documents, joined on a hash of the text, and maximal spans are removed.

The corpus is its own reference, so broadcasting the automata of all shards would grow with the input, and every document would
stream through all of them. Steps 3 to 5 are the exact way for what exceeds the broadcast shard: segments are sent to the one shard that can
match them, and memory is bounded by SHARD segments. Null text has no words; a text shorter than a window keeps all; equal rows repeat each
other; an empty table gives an empty table; extra columns of any name stay. Two different windows count as equal only if 128 bits of hash agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch, forget, gram_hashes, groups_of, hash_words, materialize, mix64, packed, record_batches, word_hashes

WINDOW = 35
#: Words of an anchor; windows hold WINDOW - K + 1 of these.
K = 12
#: Distinct segments in one automaton that is dealt out, about; segments in the one that is broadcast and anchors that they come from, at most.
SHARD, BROADCAST, COMMON_ANCHORS = 2000, 1024, 512
_P = 0x9FB21C651E98DF25
_PINV = pow(_P, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers 0..n of the base and of its inverse."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((_P, _PINV)):
            out = np.full(n + 1, np.uint64(base), dtype=np.uint64)
            out[0] = 1
            _powers[i] = np.multiply.accumulate(out)
    return _powers


class Reference:
    """The shard that is broadcast: its automaton over words numbered by hash, and its K-grams in order."""

    def __init__(self, segments: list[np.ndarray]):
        self.ids: dict[int, int] = {}
        self.automaton = Automaton()
        grams = [gram_hashes(words, K) for words in segments]
        self.grams = np.unique(np.concatenate(grams)) if grams else np.zeros(0, dtype=np.uint64)
        for words in segments:
            self.automaton.add([self.ids.setdefault(w, len(self.ids)) for w in words.tolist()], 1)
        self.automaton.finish()

    def windows(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where windows start that the shard holds, in some texts."""
        grams = gram_hashes(words, K)
        width = WINDOW - K + 1
        if not len(self.grams) or len(grams) < width:
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        held = np.concatenate(([0], np.cumsum(self.grams[at] == grams)))
        starts = np.arange(len(grams) - width + 1)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(starts)]
        may = np.flatnonzero((held[width:] - held[:-width] == width) & (starts + WINDOW <= bounds[text + 1]))
        found = []
        for run in np.split(may, np.flatnonzero(np.diff(may) != 1) + 1):
            if len(run):
                streamed = [self.ids.get(w, -1) for w in words[run[0] : run[-1] + WINDOW].tolist()]
                seen = self.automaton.occurrences(streamed, WINDOW)
                found.append(run[0] + np.flatnonzero(seen))
        return np.concatenate(found) if found else np.zeros(0, dtype=np.int64)


class Anchors:
    """The anchor occurrences that own windows in some texts: hash, segment hash, first window, number of windows, text."""

    def __init__(self, words: np.ndarray, bounds: np.ndarray):
        grams = gram_hashes(words, K)
        width = WINDOW - K + 1
        self.hash = self.segment = self.first = self.owned = self.text = np.zeros(0, dtype=np.int64)
        if len(grams) < width:
            return
        starts = np.arange(len(grams) - width + 1)
        at = starts + np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(starts)]
        inside = starts + WINDOW <= bounds[text + 1]
        new = inside & ((np.diff(at, prepend=-1) != 0) | ~np.concatenate(([False], inside[:-1])))
        self.first = np.flatnonzero(new)
        if not len(self.first):
            return
        self.owned = np.add.reduceat(inside.astype(np.int64), self.first)
        self.text = text[self.first]
        places = at[self.first]
        self.hash = grams[places].view(np.int64)
        up, down = _power(len(words))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)], dtype=np.uint64)))
        content = (sums[self.first + self.owned + WINDOW - 1] - sums[self.first]) * down[self.first]
        shape = (self.owned * 64 + places - self.first).astype(np.uint64)
        self.segment = mix64(content + np.uint64(0x632BE59BD9B4E019) * shape).view(np.int64)


class Automaton:
    """A suffix automaton of several sequences; counts[state] is how often its strings occur, weighted."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.counts = [-1], [0], [0]

    def _state(self, length: int, edges: dict[int, int], link: int) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.counts.append(0)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the longest string of p followed by c, cloned from q if q holds longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            q = self.next[last].get(c)
            if q is not None:
                last = self._split(last, c, q)
            else:
                new, p = self._state(self.length[last] + 1, {}, 0), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    self.link[new] = self._split(p, c, self.next[p][c])
                last = new
            self.counts[last] += weight

    def finish(self) -> None:
        """Hands the counts of prefixes down to their suffixes."""
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.counts[self.link[s]] += self.counts[s]

    def occurrences(self, sequence: list[int], size: int) -> list[int]:
        """For each run of `size` symbols of a sequence: how often it occurs. Matches are kept no longer than size."""
        state, matched, out = 0, 0, []
        for i, c in enumerate(sequence):
            while state and c not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if c in self.next[state]:
                state, matched = self.next[state][c], matched + 1
            while self.link[state] >= 0 and self.length[self.link[state]] >= size:
                state = self.link[state]
            matched = min(matched, size)
            if i + 1 >= size:
                out.append(self.counts[state] if matched == size else 0)
        return out


def text_id(text: str = "text") -> F.Column:
    """A hash that joins a text with its marks; a mark is applied only if its segment's hash fits the text."""
    return F.xxhash64(F.lit(5), F.coalesce(F.col(text), F.lit("")))


def _arrow(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(schema))


def _occurrences(docs: DataFrame) -> DataFrame:
    def find(batch: pa.RecordBatch) -> dict:
        keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        out = []
        for part in groups_of(texts):
            words, bounds = hash_words(texts[part])
            x = Anchors(words, bounds)
            out.append((keys[part][x.text], x.hash, x.segment, (x.first - bounds[x.text]).astype(np.int32), x.owned.astype(np.int32)))
        return dict(zip(("key", "anchor", "segment", "first", "owned"), map(np.concatenate, zip(*out, strict=True)), strict=True))

    return by_batch(docs.select("key", "text"), find, "key bigint, anchor bigint, segment bigint, first int, owned int")


def _contents(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (key, anchor, segment, first, owned, n, shards) with the segments' word hashes, from the texts."""
    # Written, so that copies of one text can be split in the join; each of them gives the same segments, which are told apart later.
    lists = materialize(wanted.groupBy("key").agg(F.collect_list(F.struct("anchor", "segment", "first", "owned", "n", "shards")).alias("want")), "wanted")
    arrow = _arrow(schema := "anchor bigint, segment bigint, n bigint, shards int, words array<bigint>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()  # copies of a text give the same segments
        for batch in batches:
            rows = []
            for key, text, want in zip(*(batch.column(i) for i in range(3)), strict=True):
                if key.as_py() not in done:
                    done.add(key.as_py())
                    words = word_hashes(text.as_py()).view(np.int64)
                    for x in want.as_py():
                        rows.append((x["anchor"], x["segment"], x["n"], x["shards"], words[x["first"] : x["first"] + x["owned"] + WINDOW - 1]))
                if len(rows) > 5000:
                    yield from record_batches(rows, arrow)
                    rows = []
            yield from record_batches(rows, arrow)

    return docs.join(lists, "key").select("key", "text", "want").mapInArrow(run, schema)


def _window_hashes(words: np.ndarray) -> np.ndarray:
    return gram_hashes(words.view(np.uint64), WINDOW, _P).view(np.int64)


def _match(segments: DataFrame) -> DataFrame:
    """Streams each shard's segments through its automaton: (anchor, segment, mask of repeated windows, windows seen once)."""
    arrow = _arrow(schema := "anchor bigint, segment bigint, n bigint, mask bigint, open array<struct<window:bigint,at:int>>")

    def shard(rows: list[tuple]) -> Iterator[tuple]:
        ids: dict[int, int] = {}
        automaton = Automaton()
        texts = []
        for _, _, n, _, words in rows:
            texts.append([ids.setdefault(w, len(ids)) for w in words])
            automaton.add(texts[-1], n)
        automaton.finish()
        for (anchor, segment, n, shards, words), text in zip(rows, texts, strict=True):
            seen = automaton.occurrences(text, WINDOW)
            mask = sum(1 << j for j, x in enumerate(seen) if x > 1)
            left = []
            if shards > 1:
                hashes = _window_hashes(np.array(words, dtype=np.int64)).tolist()
                left = [{"window": h, "at": j if x == 1 else -1} for j, (h, x) in enumerate(zip(hashes, seen, strict=True))]
            yield anchor, segment, n, mask, left

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[tuple] = []
        key, out = None, []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                if row[:2] != key:
                    out += shard(own)
                    key, own = row[:2], []
                if not own or own[-1][1] != row[2]:
                    own.append((row[0], *row[2:]))
                if len(out) > 5000:
                    yield from record_batches(out, arrow)
                    out = []
        out += shard(own)
        if out:
            yield from record_batches(out, arrow)

    salted = segments.withColumn("salt", F.pmod("segment", "shards"))
    dealt = salted.select("anchor", "salt", "segment", "n", "shards", "words").repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", "segment")
    return dealt.mapInArrow(run, schema)


def reference(docs: DataFrame, occurrences: DataFrame, repeated: DataFrame) -> tuple[Reference, DataFrame]:
    """The shard to broadcast and its (anchor, segment); both are bounded by BROADCAST."""
    common = repeated.orderBy(F.desc("total"), "anchor").limit(COMMON_ANCHORS).select("anchor")
    counted = occurrences.join(F.broadcast(common), "anchor").groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "owned")).alias("one"))
    chosen = materialize(counted.where("n > 1").orderBy(F.desc("n"), "anchor", "segment").limit(BROADCAST), "chosen")
    wanted = chosen.select("one.*", "anchor", "segment", "n", F.lit(1).alias("shards"))
    words = {(r.anchor, r.segment): r.words for r in _contents(docs, wanted).select("anchor", "segment", "words").collect()}
    return Reference([np.array(w, dtype=np.int64).view(np.uint64) for _, w in sorted(words.items())]), chosen.select("anchor", "segment")


def marks(docs: DataFrame) -> tuple[Reference, DataFrame]:
    """The broadcast shard, and (key, list of (first, owned, segment, mask)): the other repeated windows of each text; docs has key and text."""
    occurrences = materialize(_occurrences(docs), "occurrences")
    totals = occurrences.groupBy("anchor").agg(F.count("*").alias("total"), F.min("segment").alias("low"), F.max("segment").alias("high"))
    # Tables are written before they are joined, so that the join has an exchange of its own on either side and hot keys can be split.
    repeated = materialize(totals.where("total > 1").select("anchor", "total", (F.col("low") == F.col("high")).alias("same")), "repeated")
    shard, chosen = reference(docs, occurrences, repeated)
    left = occurrences.join(F.broadcast(chosen), ["anchor", "segment"], "left_anti")  # at most BROADCAST rows
    hits = materialize(left.join(repeated.select("anchor", "same"), "anchor"), "anchors")
    forget(occurrences)
    sure = hits.where("same").select("key", "first", "owned", "segment", F.lit((1 << WINDOW - K + 1) - 1).cast("long").alias("mask"))
    mixed = hits.where("not same")
    distinct = materialize(mixed.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("key", "first", "owned")).alias("one")), "distinct")
    sizes = materialize(distinct.groupBy("anchor").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards")), "sizes")
    wanted = distinct.join(sizes, "anchor").select("one.*", "anchor", "segment", "n", "shards")
    matched = materialize(_match(_contents(docs, wanted)), "matched")
    opened = matched.select("anchor", "segment", "n", F.explode("open").alias("o")).select("anchor", "segment", "n", "o.*")
    across = opened.groupBy("anchor", "window").agg(F.sum("n").alias("times")).where("times > 1").select("anchor", "window")
    more = opened.where("at >= 0").join(across, ["anchor", "window"]).groupBy("anchor", "segment").agg(F.bit_or(F.expr("shiftleft(1L, at)")).alias("more"))
    masks = matched.join(more, ["anchor", "segment"], "left").select("anchor", "segment", F.col("mask").bitwiseOR(F.coalesce("more", F.lit(0).cast("long"))).alias("mask")).where("mask <> 0")
    masks = materialize(masks, "masks")
    found = sure.unionByName(mixed.join(masks, ["anchor", "segment"]).select("key", "first", "owned", "segment", "mask"))
    out = materialize(found.groupBy("key").agg(F.collect_set(F.struct("first", "owned", "segment", "mask")).alias("marks")), "marks")
    forget(repeated, hits, distinct, sizes, matched, masks)
    return shard, out


def covered(texts: list[str | None], found: pa.ListArray, shard: Reference) -> list[np.ndarray]:
    """For each text, which of its words lie in a repeated window: one of the broadcast shard, or a marked one."""
    out: list[np.ndarray] = []
    counts = found.value_lengths().fill_null(0).to_numpy()
    flat = found.flatten()
    first, owned, segment, mask = (flat.field(i).to_numpy() for i in range(4))
    begin = np.concatenate(([0], np.cumsum(counts)))
    for part in groups_of(texts):
        words, bounds = hash_words(texts[part])
        change = np.zeros(len(words) + 1, dtype=np.int64)
        held = shard.windows(words, bounds)
        np.add.at(change, held, 1)
        np.add.at(change, held + WINDOW, -1)
        own = slice(begin[part.start], begin[part.stop])
        if own.stop > own.start:
            x = Anchors(words, bounds)
            at = np.repeat(bounds[:-1], counts[part]) + first[own]
            place = np.minimum(np.searchsorted(x.first, at), max(0, len(x.first) - 1))
            fits = (x.first[place] == at) & (x.segment[place] == segment[own]) if len(x.first) else np.zeros(len(at), dtype=bool)
            for j in range(WINDOW - K + 1):
                on = at[fits & (j < owned[own]) & (mask[own] >> j & 1 == 1)] + j
                np.add.at(change, on, 1)
                np.add.at(change, on + WINDOW, -1)
        gone = np.cumsum(change)[:-1] > 0
        out += [gone[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def _cut(df: DataFrame, text: str, keep: list[str], fn: Callable[[list[str | None], list[np.ndarray]], dict], schema: str) -> DataFrame:
    """The columns to keep in `row`, and what fn makes of the texts and their covered words."""
    shard, found = marks(df.select(text_id(text).alias("key"), F.col(text).alias("text")))
    shared = df.sparkSession.sparkContext.broadcast(shard)
    named = packed(df, text_id(text).alias("key"), F.col(text).alias("text"), keep=keep)
    joined = named.join(found.withColumnRenamed("key", "found"), F.col("key") == F.col("found"), "left").select("row", "text", "marks")

    def run(batch: pa.RecordBatch) -> dict:
        texts = batch.column(1).to_pylist()
        return {"row": batch.column(0)} | fn(texts, covered(texts, batch.column(2), shared.value))

    return by_batch(joined, run, f"row {dict(named.dtypes)['row']}, {schema}")


def remove_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """df with repeated windows cut from its texts; words that stay are joined by spaces, untouched texts stay as they are."""

    def cut(texts: list[str | None], gone: list[np.ndarray]) -> dict:
        return {"kept": [b" ".join(w for w, g in zip(x.encode().split(), own, strict=True) if not g).decode() if own.any() else x for x, own in zip(texts, gone, strict=True)]}

    return _cut(df, text, [c for c in df.columns if c != text], cut, "kept string").select(*(F.col("kept").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in df.columns))


def op6_substrings(documents: DataFrame) -> DataFrame:
    """Per document: its words, how many lie in windows that start elsewhere too, and a digest of the others."""

    def digest(texts: list[str | None], gone: list[np.ndarray]) -> dict:
        words = [(x or "").encode("utf-8", "surrogatepass").split() for x in texts]
        kept = [[w for w, g in zip(x, own.tolist(), strict=True) if not g] if own.any() else x for x, own in zip(words, gone, strict=True)]
        return {"n_words": [len(x) for x in words], "n_removed": [len(x) - len(y) for x, y in zip(words, kept, strict=True)], "kept_sha256": [hashlib.sha256(b" ".join(x)).hexdigest() for x in kept]}

    found = _cut(documents, "text", ["doc_id"], digest, "n_words bigint, n_removed bigint, kept_sha256 string")
    return found.select("row.doc_id", "n_words", "n_removed", "kept_sha256")


#: Every window as a string.
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
p AS (SELECT r, unnest(range(1, len(w) - {WINDOW - 2})) AS pos, w FROM d WHERE len(w) >= {WINDOW}),
x AS (SELECT r, pos, md5(array_to_string(w[pos:pos + {WINDOW - 1}], ' ')) AS h FROM p),
twice AS (SELECT h FROM x GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, unnest(range(pos, pos + {WINDOW})) AS i FROM x JOIN twice USING (h)),
lost AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i : NOT list_contains(gone, i)), lambda i : w[i]) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN lost USING (r)
"""
