"""What the corpus operators share: tables, Arrow batches and word hashing."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import forget, materialize, shared_dir  # noqa: F401

#: What separates words: the bytes 0x20 and 0x09 to 0x0D; everything else belongs to a word.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
#: Words are hashed in pieces of about this many bytes, so that one huge text needs little memory.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def findable(spark: SparkSession) -> None:
    """Lets Python workers on the driver's machine import this package wherever the driver was started. A cluster has it installed or
    gets it with --py-files."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def packed(df: DataFrame, *more: Column, keep: list[str] | None = None) -> DataFrame:
    """All of df's columns, or those to keep, in one called `row`, so that none clashes with the operator's own, and any others."""
    columns = df.columns if keep is None else keep
    return df.select((F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0))).alias("row"), *more)


def unpacked(df: DataFrame, columns: list[str], *more: Column | str) -> DataFrame:
    """The named columns of `row` again, and any others."""
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in columns), *more)


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], list | dict | Iterator[list | dict]], schema: str) -> DataFrame:
    """Runs fn on every Arrow batch; it returns a list of row tuples or a dict of columns, or yields some of these one after the other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                for part in (out,) if isinstance(out, (list, dict)) else out:
                    yield from record_batches(part, arrow)

    return df.mapInArrow(run, schema)


def record_batches(out: list | dict, arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    if isinstance(out, dict):
        yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
    elif out:
        columns = list(zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0xD6E8FEB86659FD93


def _powers(n: int, base: int = _BASE) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(256)


def chunks(data: bytes) -> Iterator[bytes]:
    """Cuts data at separators into pieces of about CHUNK_BYTES; a longer word stays whole."""
    at = 0
    while len(data) - at > CHUNK_BYTES:
        cut = at + CHUNK_BYTES
        while cut < len(data) and not _SEPARATOR[data[cut]]:
            cut += 1
        yield data[at:cut]
        at = cut
    yield data[at:]


def hash_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of the whole texts, in order, and where each text's words begin and end."""
    global _POWERS
    parts = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
    begin = np.cumsum([0] + [len(x) + 1 for x in parts])
    hashes, places, at_byte = [], [], 0
    for data in chunks(b" ".join(parts)):
        buf = np.frombuffer(data, dtype=np.uint8)
        letter = ~_SEPARATOR[buf]
        edge = np.flatnonzero(np.diff(letter, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if len(starts):
            lengths = ends - starts
            if (longest := int(lengths.max())) > len(_POWERS):
                _POWERS = _powers(longest)
            at = np.flatnonzero(letter)
            first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            within = np.arange(len(at)) - np.repeat(first, lengths)
            sums = np.add.reduceat(_BYTE[buf[at]] * _POWERS[within], first)
            hashes.append(mix64(sums + lengths.astype(np.uint64)))
            places.append(starts + at_byte)
        at_byte += len(data)
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(places), begin)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of the whole text, in order."""
    return hash_words([text])[0]


def groups_of(texts: list[str | None], size: int = CHUNK_BYTES) -> Iterator[slice]:
    """Runs of texts of about `size` characters together, so that numpy works on few, short arrays."""
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= size):
            total += len(texts[end] or "")
            end += 1
        yield slice(at, end)
        at = end


_GRAM = 0xA24BAED4963EE407


def gram_hashes(words: np.ndarray, k: int, base: int = _GRAM) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive words."""
    if len(words) < k:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(words) - k + 1, dtype=np.uint64)
    for j in range(k):
        out *= np.uint64(base)
        out += words[j : j + len(out)]
    return mix64(out)
