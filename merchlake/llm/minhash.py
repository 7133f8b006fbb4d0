"""Near-duplicate documents: BagMinHash signatures, banding, and verified multiset overlap.

A document is the multiset of its shingles of `SHINGLE` words (a shorter one: of all its words). BagMinHash gives a
signature whose slots agree between two multisets with a probability of their weighted Jaccard similarity. A weight w is discretised at 0, 1, 2, 4,
8, ...: every such interval has a Poisson process of points of its own, with a rate of the interval's length, drawn from a
hash of shingle and interval. A point of a long interval splits it in halves and falls into one of them, down to intervals of length one;
halves above w are dropped. Each point falls into a slot, and each slot keeps the time of its earliest point. Points are made
in order of time up to a limit at which all slots are filled, so a document needs some m log m points and one
per shingle, not m per shingle.

Everything goes by text: equal texts are one node, whatever their keys, so rows that share a key stay apart if their texts differ. Nodes
that share a band of slots are candidates; the candidates of a bucket are compared with its least member rather than all with each other, and
linked where the multiset overlap is at least `THRESHOLD`. Members of a bucket that the links leave outside of its largest group are then
compared with all members, in blocks, so that no candidate pair whose link could change the result is left out. What is compared are sorted
shingle hashes, made once for each node that has a candidate.

A class is named by its least key and kept by the row of that key (of several texts with that key, the one of least MD5). Rows without a key
belong to the class of their text and come last in it. Null texts and texts without words are classes of their own; extra columns do not
matter; rows that repeat in full get equal results, of which `deduplicate` keeps one; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, by_batch, forget, gram_hashes, groups_of, hash_words, materialize, mix64, packed, record_batches, unpacked, word_hashes
from .components import components

SHINGLE = 5
THRESHOLD = 0.8
#: Bands of the signature and slots in each: at a similarity of 0.8 a pair shares a band with probability 0.9999.
BANDS, ROWS = 24, 5
SLOTS = BANDS * ROWS
#: Members of a bucket that meet in one block, and their shingles, about.
BLOCK, BLOCK_ITEMS = 512, 1 << 22


def shingles(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of some texts, and the text of each."""
    sizes = np.diff(bounds)
    grams = gram_hashes(words, SHINGLE)
    starts = np.arange(len(grams))
    text = np.repeat(np.arange(len(sizes)), sizes)
    inside = starts + SHINGLE <= bounds[text[: len(grams)] + 1] if len(grams) else np.zeros(0, dtype=bool)
    found, owner = [grams[inside]], [text[: len(grams)][inside]]
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        own = words[bounds[i] : bounds[i + 1]]
        found.append(gram_hashes(own, len(own)) ^ np.uint64(len(own)))
        owner.append(np.array([i]))
    return np.concatenate(found), np.concatenate(owner)


def multiset(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a whole text, sorted, and how often each occurs."""
    words = word_hashes(text)
    return np.unique(shingles(words, np.array([0, len(words)]))[0], return_counts=True)


def _uniform(key: np.ndarray) -> np.ndarray:
    return ((mix64(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _key(item: np.ndarray, low: np.ndarray, width: np.ndarray, n: np.ndarray, salt: int) -> np.ndarray:
    """What the n-th draw of an interval's process depends on: never the weight, so all sets share the points."""
    place = low * np.uint64(0x9E3779B97F4A7C15) + width * np.uint64(0xC2B2AE3D27D4EB4F) + n * np.uint64(0x165667B19E3779F9)
    return item ^ mix64(place + np.uint64(salt))


def _sketch(items: np.ndarray, weights: np.ndarray, owners: np.ndarray, limit: np.ndarray, times: np.ndarray) -> None:
    """Lowers each slot's time to its earliest point up to the owner's limit."""
    weights = weights.astype(np.uint64)
    begun, low, high = [], 0, 1
    while low < int(weights.max(initial=0)):  # the intervals (0, 1], (1, 2], (2, 4], (4, 8], ... that begin below the weight
        on = np.flatnonzero(weights > low)
        begun.append((on, np.full(len(on), low, dtype=np.uint64), np.full(len(on), high - low, dtype=np.uint64)))
        low, high = high, 2 * high
    if not begun:
        return
    at, low, width = (np.concatenate(x) for x in zip(*begun, strict=True))
    time, n = np.zeros(len(at)), np.zeros(len(at), dtype=np.uint64)

    def drawn(at, low, width, n, time):
        """The next point of each process, of those within the limit."""
        time = time - np.log(_uniform(_key(items[at], low, width, n, 1))) / width.astype(np.float64)
        keep = (time <= limit[owners[at]]) & (low < weights[at])
        return at[keep], low[keep], width[keep], n[keep], time[keep]

    at, low, width, n, time = drawn(at, low, width, n, time)
    while len(at):
        unit = width == 1
        a, lo, k, t = at[unit], low[unit], n[unit], time[unit]
        slot = (mix64(_key(items[a], lo, width[unit], k, 2)) % np.uint64(SLOTS)).astype(np.int64)
        np.minimum.at(times, owners[a] * SLOTS + slot, t)
        following = drawn(a, lo, width[unit], k + np.uint64(1), t)
        if unit.all():
            at, low, width, n, time = following
            continue
        # A point of a longer interval falls into one half of it; the other half's first point comes later.
        a, lo, w, k, t = (x[~unit] for x in (at, low, width, n, time))
        half = w >> np.uint64(1)
        right = mix64(_key(items[a], lo, w, k, 3)) & np.uint64(1)
        none = np.zeros_like(k)
        into, other = lo + half * right, lo + half * (np.uint64(1) - right)
        below = into < weights[a]
        hit = (a[below], into[below], half[below], none[below], t[below])
        at, low, width, n, time = (np.concatenate(x) for x in zip(following, hit, drawn(a, other, half, none, t), strict=True))


def bag_min_hash(items: np.ndarray, weights: np.ndarray, owners: np.ndarray, n_owners: int) -> np.ndarray:
    """Signatures (n_owners by SLOTS) of weighted sets, given as each owner's distinct items with whole weights."""
    total = np.bincount(owners, weights=weights, minlength=n_owners)
    times = np.full(n_owners * SLOTS, np.inf)
    limit = SLOTS * (np.log(SLOTS) + 3.0) / np.maximum(total, 1)
    left = total > 0
    while left.any():  # again with twice the limit where a slot stayed empty, for about one set in twenty
        mine = left[owners]
        _sketch(items[mine], weights[mine], owners[mine], limit, times)
        left &= np.isinf(times.reshape(n_owners, SLOTS)).any(axis=1)
        limit = limit * 2
    return times.view(np.uint64).reshape(n_owners, SLOTS)


def signatures(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The signature of each text and how many shingles it has."""
    words, bounds = hash_words(texts)
    found, owner = shingles(words, bounds)
    key = found ^ mix64(owner.astype(np.uint64) + np.uint64(1))
    _, first, weights = np.unique(key, return_index=True, return_counts=True)
    return bag_min_hash(found[first], weights, owner[first], len(texts)), np.bincount(owner.astype(np.int64), minlength=len(texts))


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A hash for each band of each signature."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.tile(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signature), 1))
    for r in range(ROWS):
        out = mix64(out ^ parts[:, :, r])
    return out.view(np.int64)


def _sketches(named: DataFrame) -> DataFrame:
    """(id, text_key, n, bands) of every row with words; n is the number of its shingles."""

    def run(batch: pa.RecordBatch) -> dict:
        ids, keys, texts = batch.column(0), batch.column(1), batch.column(2).to_pylist()
        bands, sizes = [], []
        for part in groups_of(texts):
            signature, n = signatures(texts[part])
            bands.append(band_keys(signature[n > 0]))
            sizes.append(n)
        n = np.concatenate(sizes)
        keep = pa.array(n > 0)
        return {"id": ids.filter(keep), "text_key": keys.filter(keep), "n": n[n > 0], "bands": list(np.concatenate(bands))}

    return by_batch(named.select("id", "text_key", "text"), run, f"id {dict(named.dtypes)['id']}, text_key string, n bigint, bands array<bigint>")


def _expanded(text: str | None) -> np.ndarray:
    """A text's shingles as a sorted set: the k-th occurrence of one is an item of its own, so common items are the multiset overlap."""
    found, n = multiset(text)
    within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.sort(np.repeat(found, n) ^ mix64(within.astype(np.uint64)))


def _items(texts: DataFrame) -> DataFrame:
    """(node, items): the sorted shingles of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        return {"node": batch.column(0), "items": [_expanded(x.as_py()).tobytes() for x in batch.column(1)]}

    return by_batch(texts.select("node", "text"), run, "node bigint, items binary")


def _compared(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b): the pairs (x, y) whose multiset overlap reaches the threshold."""
    one = items.select(F.col("node").alias("x"), F.col("items").alias("items_x"))
    two = items.select(F.col("node").alias("y"), F.col("items").alias("items_y"))
    both = pairs.join(one, "x").join(two, "y").select("x", "y", "items_x", "items_y")

    def run(batch: pa.RecordBatch) -> dict:
        linked = []
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            own, other = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            at = np.minimum(np.searchsorted(other, own), len(other) - 1)
            common = int((other[at] == own).sum())
            linked.append(common >= THRESHOLD * (len(own) + len(other) - common))
        keep = pa.array(linked, pa.bool_())
        return {"a": batch.column(0).filter(keep), "b": batch.column(1).filter(keep)}

    return by_batch(both, run, "a bigint, b bigint")


def _linked_components(query: list[tuple[int, np.ndarray]], base: list[tuple[int, np.ndarray]]) -> set[tuple[int, int]]:
    """Pairs of components with a link between a query and a base member, given as (component, items)."""
    items = np.concatenate([x for _, x in base])
    owner = np.repeat(np.arange(len(base)), [len(x) for _, x in base])
    order = np.argsort(items, kind="stable")
    items, owner = items[order], owner[order]
    sizes = np.array([len(x) for _, x in base])
    component = np.array([c for c, _ in base])
    out = set()
    for c, own in query:
        low, high = np.searchsorted(items, own, "left"), np.searchsorted(items, own, "right")
        n = high - low
        hits = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[hits], minlength=len(base))
        linked = (common >= THRESHOLD * (len(own) + sizes - common)) & (component != c)
        out.update((c, int(d)) for d in np.unique(component[linked]))
    return out


def _across(at: DataFrame, split: DataFrame, items: DataFrame) -> DataFrame:
    """(a, b): components that a pair in one bucket links. Every member outside of the bucket's largest component meets all members,
    in blocks of bounded size; pairs are compared inside the blocks and never become rows."""
    rows = at.join(split, "bucket")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    base = rows.select("bucket", own("nb", 1).alias("b"), every("nq").alias("q"), F.lit(False).alias("asks"), "node", "component")
    asks = rows.where("component <> largest").select("bucket", every("nb").alias("b"), own("nq", 2).alias("q"), F.lit(True).alias("asks"), "node", "component")
    both = base.unionByName(asks).join(items, "node").select("bucket", "b", "q", "asks", "component", "items")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, query, members = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if query and members:
                yield from record_batches(sorted(_linked_components(query, members)), schema)

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for bucket, b, q, asking, component, own in zip(*columns, batch.column(5), strict=True):
                if (bucket, b, q) != key:
                    yield from done()
                    key, query, members = (bucket, b, q), [], []
                # a copy, as the batch goes
                (query if asking else members).append((component, np.frombuffer(own.as_py(), np.uint64)))
        yield from done()

    dealt = both.repartition("bucket", "b", "q").sortWithinPartitions("bucket", "b", "q")
    return dealt.mapInArrow(run, "a bigint, b bigint")


def _text_key(text: str) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def _identity(key: Column, text_key: Column) -> Column:
    """What tells a row from others: its key and its text."""
    return F.md5(F.concat_ws("/", F.coalesce(key.cast("string"), F.lit("")), key.isNull().cast("string"), text_key).cast("binary"))


def text_classes(named: DataFrame) -> DataFrame:
    """(text_key, class_id, least) of every text with words; named has id, text_key and text. least is the _identity of the class's first row."""
    sketched = materialize(_sketches(named), "sketches")
    # Written, so that a node's number stays and later joins have an exchange of their own on either side, whose hot keys can be split.
    per_text = sketched.groupBy("text_key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(per_text.withColumn("node", F.monotonically_increasing_id()), "nodes")
    forget(sketched)
    buckets = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    shared = materialize(buckets.groupBy("bucket").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("bucket", "low"), "shared")
    members = materialize(buckets.join(shared, "bucket"), "members")
    involved = members.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    # One row per text before the join, so that copies of a text never meet in one task.
    texts = named.groupBy("text_key").agg(F.first("text").alias("text")).join(involved, "text_key")
    items = materialize(_items(texts), "items")
    links = materialize(_compared(members.where("node <> low").select(F.col("node").alias("x"), F.col("low").alias("y")).distinct(), items), "compared")
    first = components(links)

    # Pairs of a bucket that the links so far leave in different components.
    at = members.join(first.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("bucket", "node", "n", F.coalesce("component", "node").alias("component"))
    sizes = at.groupBy("bucket", "component").agg(F.count("*").alias("count"), F.sum("n").alias("n"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("count", "n", "component")).alias("most"), F.sum("count").alias("count"), F.sum("n").alias("n"), F.count("*").alias("parts"))
    blocks = lambda count, n: F.greatest(F.ceil(count / F.lit(BLOCK)), F.ceil(n / F.lit(BLOCK_ITEMS))).cast("int")
    # of a bucket of two, the one pair is among those that were compared
    split = largest.where("parts > 1 AND count > 2").select(
        "bucket", F.col("most.component").alias("largest"), blocks(F.col("count"), F.col("n")).alias("nb"), blocks(F.col("count") - F.col("most.count"), F.col("n") - F.col("most.n")).alias("nq")
    )
    split = materialize(split, "split")
    edges = materialize(_across(at, split, items), "across")
    label = first if edges.isEmpty() else components(first.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(edges))
    each = nodes.join(label.withColumnRenamed("node", "linked"), F.col("node") == F.col("linked"), "left").select("text_key", "id", F.coalesce("component", "node").alias("component"))
    least = materialize(each.groupBy("component").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("least")), "least")
    out = materialize(each.join(least, "component").select("text_key", F.col("least.id").alias("class_id"), _identity(F.col("least.id"), F.col("least.text_key")).alias("least")), "classes")
    forget(nodes, shared, members, items, links, first, split, edges, label, least)
    return out


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, kept) for each row: class_id is the least key of the class, kept is whether the row is the one that stays."""
    named = df.select(F.col(key).alias("id"), _text_key(text).alias("text_key"), F.col(text).alias("text"))
    found = text_classes(named).withColumnRenamed("text_key", "found")
    joined = named.select("id", "text_key").join(found, F.col("text_key") == F.col("found"), "left")
    kept = F.col("found").isNull() | (F.col("least") == _identity(F.col("id"), F.col("text_key")))
    return joined.select(F.col("id").alias(key), F.when(F.col("found").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), kept.alias("kept"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class of texts, the one that near_duplicates() keeps; documents without words stay, once for each key."""
    text_key = _text_key(text)
    found = text_classes(df.select(F.col(key).alias("id"), text_key.alias("text_key"), F.col(text).alias("text")))
    kept = found.select(F.col("least").alias("identity")).distinct().withColumn("first", F.lit(True))
    worded = F.coalesce(F.col(text).rlike(WORD_PATTERN), F.lit(False))
    # Rows that repeat in full are dropped with partial aggregation, before the join.
    once = packed(df, worded.alias("worded"), _identity(F.col(key), text_key).alias("identity")).groupBy("identity").agg(F.first("row").alias("row"), F.first("worded").alias("worded"))
    return unpacked(once.join(kept, "identity", "left").where("first OR NOT worded"), df.columns)


def op4_near_duplicates(documents: DataFrame) -> DataFrame:
    """Every document's class of near-duplicates and whether it is the one that stays."""
    return near_duplicates(documents)


#: All pairs that share a shingle, and their components.
ORACLE_SQL = """
WITH RECURSIVE t AS (
  SELECT text, any_value(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS w, min(doc_id) AS low, md5(text) AS text_key FROM documents
  WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
n AS (SELECT row_number() OVER (ORDER BY text_key) AS k, * FROM t),
g AS (
  SELECT k, gram, count(*) AS c FROM (
    SELECT k, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' ')) END) AS gram FROM n)
  GROUP BY k, gram),
z AS (SELECT k, sum(c) AS s FROM g GROUP BY k),
common AS (SELECT a.k AS x, b.k AS y, sum(least(a.c, b.c)) AS m FROM g a JOIN g b ON a.gram = b.gram AND a.k <> b.k GROUP BY 1, 2),
link AS (SELECT x, y FROM common JOIN z a ON a.k = x JOIN z b ON b.k = y WHERE 10 * m >= 8 * (a.s + b.s - m)),
reach AS (SELECT k, k AS root FROM n UNION SELECT l.y, r.root FROM reach r JOIN link l ON l.x = r.k),
top AS (SELECT k, min(root) AS root FROM reach GROUP BY k),
class AS (
  SELECT text, first_value(low) OVER best AS class_id, first_value(text_key) OVER best AS kept_text
  FROM n JOIN top USING (k) WINDOW best AS (PARTITION BY root ORDER BY low NULLS LAST, text_key))
SELECT d.doc_id, CASE WHEN c.text IS NULL THEN d.doc_id ELSE c.class_id END AS class_id,
  c.text IS NULL OR (d.doc_id IS NOT DISTINCT FROM c.class_id AND md5(d.text) = c.kept_text) AS kept
FROM documents d LEFT JOIN class c ON c.text = d.text
"""
