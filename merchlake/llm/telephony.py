"""Telephony audio in media columns: G.711 and IMA ADPCM containers, decoding and resampling.

A media column holds whole WAV files. `store` writes 8-bit samples (mu-law or A-law codes, or 64-byte
ADPCM blocks, whatever the bytes) without loss; `to_pcm` expands such files to linear PCM at twice the
rate in a column of its own; `digests` reads both back and describes them. Null media count as empty payloads, a payload is
padded with zero bytes to a positive multiple of 64, equal payloads give equal files and features, and
further columns of any name pass through `store` and `to_pcm`. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, groups_of

RATE = 8000
BLOCK = 64
#: WAV format tags.
FORMATS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
#: Files are decoded together up to about this many bytes.
GROUP_BYTES = 2 << 20

# Fixed values of the IMA ADPCM format: quantiser steps, and index changes by the low three bits.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060,
    1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132,
    7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
])
INDEX_CHANGE = np.array([-1, -1, -1, -1, 2, 4, 6, 8])


def _mulaw_table() -> np.ndarray:
    code = ~np.arange(256) & 0xFF
    size = ((((code & 0x0F) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _alaw_table() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    exponent, mantissa = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(exponent == 0, mantissa + 8, (mantissa + 0x108) << np.maximum(exponent - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


def _adpcm_tables() -> tuple[np.ndarray, np.ndarray]:
    """The change of the sample and the next index, for each index and nibble."""
    nibble, step = np.arange(16)[None, :], STEPS[:, None]
    size = (step >> 3) + (nibble & 1) * (step >> 2) + (nibble >> 1 & 1) * (step >> 1) + (nibble >> 2 & 1) * step
    change = np.where(nibble & 8, -size, size)
    following = np.clip(np.arange(89)[:, None] + INDEX_CHANGE[nibble & 7], 0, 88)
    return change.astype(np.int32).ravel(), following.astype(np.int32).ravel()


EXPAND = {"mulaw": _mulaw_table(), "alaw": _alaw_table()}
_CHANGE, _NEXT = _adpcm_tables()


def pad(payload: bytes) -> bytes:
    return payload + bytes(-len(payload) % BLOCK if payload else BLOCK)


def codec_for(payload: bytes) -> str:
    """Which format stores a payload: by its checksum, so equal payloads share one."""
    return sorted(FORMATS)[hashlib.sha256(payload).digest()[0] % 3]


def encode_wav(payload: bytes, codec: str) -> bytes:
    extra = struct.pack("<HH", 2, 2 * (BLOCK - 4) + 1) if codec == "adpcm" else struct.pack("<H", 0)
    align, bits = (BLOCK, 4) if codec == "adpcm" else (1, 8)
    rate = RATE * BLOCK // (2 * (BLOCK - 4) + 1) if codec == "adpcm" else RATE
    fmt = struct.pack("<HHIIHH", FORMATS[codec], 1, RATE, rate, align, bits) + extra
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", len(payload)) + payload
    body += bytes(len(payload) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


class Stored(NamedTuple):
    codec: str
    rate: int
    payload: bytes


def read_wav(media: bytes) -> Stored:
    """The codec, the rate and the stored bytes of a file that holds one of FORMATS."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, codec, rate = 12, "", 0
    while at + 8 <= len(media):
        kind, (size,) = media[at : at + 4], struct.unpack_from("<I", media, at + 4)
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
            codec = next((k for k, v in FORMATS.items() if v == tag), "")
        elif kind == b"data" and codec:
            return Stored(codec, rate, media[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    raise ValueError("no supported audio in the file")


def decode_blocks(blocks: np.ndarray) -> np.ndarray:
    """Decodes ADPCM blocks (rows of bytes) side by side: one numpy step advances every block by a sample."""
    blocks = np.ascontiguousarray(blocks, dtype=np.uint8)
    sample = blocks[:, :2].copy().view("<i2")[:, 0].astype(np.int32)
    index = np.minimum(blocks[:, 2], 88).astype(np.int32)
    body = blocks[:, 4:].T
    out = np.empty((1 + 2 * len(body), len(blocks)), dtype=np.int16)
    out[0] = sample
    for j, byte in enumerate(body):
        for half, nibble in enumerate((byte & 15, byte >> 4)):
            flat = index * 16 + nibble
            sample += _CHANGE[flat]
            np.clip(sample, -32768, 32767, out=sample)
            index = _NEXT[flat]
            out[1 + 2 * j + half] = sample
    return out.T


def decode(files: list[Stored]) -> list[np.ndarray]:
    """Linear samples of each file; the ADPCM blocks of all files are decoded together."""
    out: list[np.ndarray | None] = [EXPAND[f.codec][np.frombuffer(f.payload, np.uint8)] if f.codec in EXPAND else None for f in files]
    waiting = [i for i, x in enumerate(out) if x is None]
    if waiting:
        whole = [f.payload[: len(f.payload) // BLOCK * BLOCK] for f in (files[i] for i in waiting)]
        samples = decode_blocks(np.frombuffer(b"".join(whole), np.uint8).reshape(-1, BLOCK))
        at = 0
        for i, data in zip(waiting, whole, strict=True):
            n = len(data) // BLOCK
            out[i] = samples[at : at + n].ravel()
            at += n
    return out


def double_rate(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: samples stay, and a four-tap filter (-1, 9, 9, -1)/16 gives those between them."""
    wide = np.pad(pcm.astype(np.int32), (1, 2), mode="edge")
    between = (9 * (wide[1:-2] + wide[2:-1]) - wide[:-3] - wide[3:] + 8) >> 4
    out = np.empty(2 * len(pcm), dtype="<i2")
    out[::2], out[1::2] = pcm, np.clip(between, -32768, 32767)
    return out


def feature(codec: str, pcm: np.ndarray) -> str:
    """codec:samples:mean size:peak:sign changes of the resampled PCM."""
    size = np.abs(pcm.astype(np.int32))
    turns = int(np.count_nonzero(np.diff(pcm < 0)))
    return f"{codec}:{len(pcm)}:{int(size.sum()) // max(1, len(pcm))}:{int(size.max(initial=0))}:{turns}"


def _groups(media: list[bytes]) -> Iterator[slice]:
    """Runs of files of about GROUP_BYTES together."""
    at = 0
    while at < len(media):
        end, size = at, 0
        while end < len(media) and (end == at or size + len(media[end]) <= GROUP_BYTES):
            size += len(media[end])
            end += 1
        yield slice(at, end)
        at = end


def stored(text: str | None) -> bytes:
    """A text's UTF-8 bytes, padded, as a WAV file in the format of codec_for."""
    payload = pad((text or "").encode("utf-8", "surrogatepass"))
    return encode_wav(payload, codec_for(payload))


def resampled(media: list[bytes | None]) -> list[bytes | None]:
    """16-bit little-endian PCM at twice the rate of each file."""
    full = [i for i, x in enumerate(media) if x]
    done = dict(zip(full, decode([read_wav(media[i]) for i in full]), strict=True))
    return [double_rate(done[i]).tobytes() if i in done else None for i in range(len(media))]


def digest(media: bytes, pcm: bytes) -> tuple:
    """What a stored file and its stored PCM hold: sizes and SHA-256 of payload, file and PCM, the payload's last CRC-32, and features."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    f = read_wav(media)
    p = f.payload
    return len(p), sha(p), zlib.crc32(p[-BLOCK:]), len(media), sha(media), feature(f.codec, np.frombuffer(pcm, "<i2")), len(pcm), sha(pcm)


_DIGEST = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pcm_bytes bigint, pcm_sha256 string"


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the column `media`: each text as a stored file."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes if n != media)}, `{media}` binary"

    def add(batch: pa.RecordBatch) -> dict:
        own = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        return own | {media: [stored(x) for x in own[text].to_pylist()]}

    return by_batch(df, add, schema)


def to_pcm(df: DataFrame, media: str = "media", pcm: str = "pcm") -> DataFrame:
    """Adds the column `pcm`: 16-bit little-endian PCM at twice the file's rate; null where media is null."""
    schema = f"{', '.join(f'`{n}` {t}' for n, t in df.dtypes if n != pcm)}, `{pcm}` binary"

    def add(batch: pa.RecordBatch) -> Iterator[dict]:
        files = [x or b"" for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
        for part in _groups(files):  # batches of few rows, as PCM is several times as large
            some = batch.slice(part.start, part.stop - part.start)
            yield {n: some.column(i) for i, n in enumerate(some.schema.names)} | {pcm: resampled(files[part])}

    return by_batch(df, add, schema)


def digests(df: DataFrame, key: str = "doc_id", media: str = "media", pcm: str = "pcm") -> DataFrame:
    """Reads stored files and their stored PCM back and describes them."""

    def describe(batch: pa.RecordBatch) -> list:
        return [(own, *digest(data.as_py(), sound.as_py())) for own, data, sound in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True)]

    return by_batch(df.select(key, media, pcm), describe, f"`{key}` {dict(df.dtypes)[key]}, {_DIGEST}")


def op1_telephony(documents: DataFrame) -> DataFrame:
    """Every document's text as stored audio and as stored PCM, read back and described; null text is an empty payload.

    The same as digests(to_pcm(store(documents))) in one pass: a group of files is stored, resampled and read back before the next one, so
    that a task holds the PCM of one group only.
    """

    def run(batch: pa.RecordBatch) -> Iterator[list]:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for part in groups_of(texts):
            files = [stored(x) for x in texts[part]]
            yield [(key, len((text or "").encode("utf-8", "surrogatepass")), *digest(data, pcm)) for key, text, data, pcm in zip(keys[part], texts[part], files, resampled(files), strict=True)]

    return by_batch(documents.select("doc_id", "text"), run, f"doc_id {dict(documents.dtypes)['doc_id']}, n_bytes bigint, {_DIGEST}")


def _le(value: str, size: int) -> str:
    """SQL for the hexadecimal digits of a little-endian number."""
    return " || ".join(f"printf('%02X', ({value} >> {8 * k}) & 255)" for k in range(size))


_CLIP = "greatest(-32768, least(32767, {}))"
#: The same by arithmetic on lists of bytes and samples.
ORACLE_SQL = f"""
WITH step AS (SELECT {STEPS.tolist()} AS steps, {INDEX_CHANGE.tolist()} AS changes,
  list_transform(range(256), lambda n : list_reduce(range(8), lambda c, k : CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n)) AS crcs),
d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS t FROM documents),
p AS (SELECT r, doc_id, len(t) // 2 AS n_bytes, t || repeat('00', CASE WHEN t = '' THEN 64 ELSE ((64 - (len(t) // 2) % 64) % 64)::INT END) AS h FROM d),
s AS (SELECT *, len(h) // 2 AS n, sha256(unhex(h)) AS sha FROM p),
c AS (SELECT *, (16 * (strpos('0123456789abcdef', sha[1]) - 1) + strpos('0123456789abcdef', sha[2]) - 1) % 3 AS kind,
  list_transform(regexp_extract_all(h, '..'), lambda x : ('0x' || x)::BIGINT) AS bytes FROM s),
f AS (SELECT *, CASE kind WHEN 0 THEN {_le(str(FORMATS["adpcm"]), 2)} WHEN 1 THEN {_le(str(FORMATS["alaw"]), 2)} ELSE {_le(str(FORMATS["mulaw"]), 2)} END || {_le("1", 2)} || {_le(str(RATE), 4)}
  || CASE WHEN kind = 0 THEN {_le(str(RATE * BLOCK // (2 * (BLOCK - 4) + 1)), 4)} || {_le(str(BLOCK), 2)} || {_le("4", 2)} || {_le("2", 2)} || {_le(str(2 * (BLOCK - 4) + 1), 2)}
     ELSE {_le(str(RATE), 4)} || {_le("1", 2)} || {_le("8", 2)} || {_le("0", 2)} END AS fmt FROM c),
m AS (SELECT *, hex(encode('WAVEfmt ')) || {_le("(len(fmt) // 2)", 4)} || fmt || hex(encode('data')) || {_le("n", 4)} || h AS body FROM f),
block AS (SELECT r, k, bytes[64 * k + 1:64 * k + 64] AS b FROM c, unnest(range(0, n // 64)) u(k) WHERE kind = 0),
start AS (SELECT r, k, CASE WHEN b[2] > 127 THEN b[1] + 256 * b[2] - 65536 ELSE b[1] + 256 * b[2] END::BIGINT AS first, least(b[3], 88)::BIGINT AS idx,
  flatten(list_transform(b[5:64], lambda x : [x % 16, x // 16])) AS nibbles FROM block),
coded AS (SELECT r, k, list_reduce(nibbles, lambda a, x : {{'s': {_CLIP.format(
    "a.s + (CASE WHEN x >= 8 THEN -1 ELSE 1 END) * ((steps[a.i + 1] >> 3) + (x & 1) * (steps[a.i + 1] >> 2) + ((x >> 1) & 1) * (steps[a.i + 1] >> 1) + ((x >> 2) & 1) * steps[a.i + 1])")},
  'i': greatest(0, least(88, a.i + changes[(x & 7) + 1])), 'o': list_append(a.o, {_CLIP.format(
    "a.s + (CASE WHEN x >= 8 THEN -1 ELSE 1 END) * ((steps[a.i + 1] >> 3) + (x & 1) * (steps[a.i + 1] >> 2) + ((x >> 1) & 1) * (steps[a.i + 1] >> 1) + ((x >> 2) & 1) * steps[a.i + 1])")})}},
  {{'s': first, 'i': idx, 'o': [first]}}).o AS o FROM start, step),
joined AS (SELECT r, flatten(list(o ORDER BY k)) AS x FROM coded GROUP BY r),
linear AS (SELECT c.r, CASE kind WHEN 0 THEN x
  WHEN 1 THEN list_transform(bytes, lambda b : CASE WHEN xor(b, 85) & 128 = 128 THEN 1 ELSE -1 END * CASE WHEN (xor(b, 85) >> 4) & 7 = 0 THEN ((xor(b, 85) & 15) << 4) + 8 ELSE (((xor(b, 85) & 15) << 4) + 264) << (((xor(b, 85) >> 4) & 7) - 1) END)
  ELSE list_transform(bytes, lambda b : CASE WHEN (255 - b) & 128 = 128 THEN -1 ELSE 1 END * ((((((255 - b) & 15) << 3) + 132) << (((255 - b) >> 4) & 7)) - 132)) END AS x
  FROM c LEFT JOIN joined USING (r)),
pcm AS (SELECT r, flatten(list_transform(range(1, len(x) + 1), lambda i : [x[i], {_CLIP.format("floor((9 * (x[i] + x[least(i + 1, len(x))]) - x[greatest(i - 1, 1)] - x[least(i + 2, len(x))] + 8) / 16)::BIGINT")}])) AS y FROM linear),
told AS (SELECT r, y, array_to_string(list_transform(y, lambda v : printf('%04X', ((v & 255) << 8) + ((v >> 8) & 255))), '') AS yh FROM pcm)
SELECT doc_id, n_bytes, n AS payload_bytes, sha AS payload_sha256,
  xor(list_reduce(bytes[n - 63:n], lambda a, b : xor(a >> 8, crcs[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS tail_crc32,
  len(body) // 2 + 8 AS media_bytes, sha256(unhex(hex(encode('RIFF')) || {_le("(len(body) // 2)", 4)} || body)) AS media_sha256,
  ['adpcm', 'alaw', 'mulaw'][kind + 1] || ':' || len(y) || ':' || list_sum(list_transform(y, lambda v : abs(v)))::BIGINT // len(y) || ':' || list_max(list_transform(y, lambda v : abs(v))) || ':'
    || len(list_filter(range(1, len(y)), lambda i : (y[i] < 0) <> (y[i + 1] < 0))) AS feature,
  2 * len(y) AS pcm_bytes, sha256(unhex(yh)) AS pcm_sha256
FROM m JOIN told USING (r), step
"""
