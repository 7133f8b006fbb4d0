"""Token ids by a public tokenizer, word by word with a bounded memory of words already seen."""

from __future__ import annotations

import re
from collections.abc import Collection
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The tokenizer that packing uses; any works that drops white space and ends the last token of a word with WORD_END.
TOKENIZER = "word_bpe_49k.json"
WORD_END = "</w>"
#: Parts of texts and words remembered by one Python worker, in each of two generations, and the longest of them in characters; longer ones
#: are encoded each time.
REMEMBERED, LONGEST = 200_000, 64
#: Words encoded by one call.
TOGETHER = 4000
_PUNCTUATION = r"[!\"#$%&()*+,\-./:;=?@\[\\\]^_`{}~]*"  # nothing that could be part of a contraction or a special token
_PART = re.compile(rf"({_PUNCTUATION})([^\W\d_]+)({_PUNCTUATION})")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Memory:
    """A bounded dict in two generations: what the old one holds moves on when it is asked for again."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: Collection[str]) -> list[str]:
        """Those that must be computed; makes room for all, so `young` holds the rest."""
        if len(self.young) + len(keys) > self.most:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        out = []
        for k in keys:
            if k not in young:
                if (found := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = found
        return out


class WordTokenizer:
    """Encodes texts to little-endian 32-bit ids. The tokenizer drops white space and matches no token across it, so a text's ids are
    those of its space-separated parts, one after the other; likewise those of a part that is a word between ASCII punctuation."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        vocabulary = self.encoder.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.parts, self.words = Memory(REMEMBERED), Memory(REMEMBERED)

    def _direct(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.encoder.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Words of letters only: joined by spaces, and the ids cut behind each word's last token."""
        out: list[bytes] = []
        for at in range(0, len(words), TOGETHER):
            some = words[at : at + TOGETHER]
            ids = np.array(self.encoder.encode(" ".join(some), add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some) or cuts[-1] != len(ids):
                out += self._direct(some)
                continue
            data, begin = ids.tobytes(), 0
            for end in (4 * cuts).tolist():
                out.append(data[begin:end])
                begin = end
        return out

    def _known(self, parts: list[str]) -> list[bytes]:
        """The ids of distinct parts."""
        plain = list(map(str.isalpha, parts))
        mixed = [p for p, x in zip(parts, plain, strict=True) if not x]
        new = self.parts.missing(mixed)
        inside: dict[str, tuple[str, str, str]] = {}
        other = []
        for part in new:
            if m := _PART.fullmatch(part):
                inside[part] = m.groups()
            elif part:
                other.append(part)
        wanted = {p for three in inside.values() for p in three if p}
        wanted.update(p for p, x in zip(parts, plain, strict=True) if x)
        fresh = self.words.missing(wanted)
        known, young = self.words.young, self.parts.young
        letters = [p for p in fresh if p.isalpha()]
        signs = [p for p in fresh if not p.isalpha()]
        known.update(zip(letters, self._encode_words(letters), strict=True))
        known.update(zip(signs, self._direct(signs), strict=True))
        young[""] = b""
        young.update(zip(other, self._direct(other), strict=True))
        get = known.get
        for part, (before, word, after) in inside.items():
            young[part] = get(before, b"") + get(word, b"") + get(after, b"")
        out = [known[p] if x else young[p] for p, x in zip(parts, plain, strict=True)]
        for memory, keys in ((young, new), (known, fresh)):
            for k in keys:
                if len(k) > LONGEST:
                    memory.pop(k, None)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Each distinct part is looked up once, and the ids of all parts are gathered from there."""
        plain = pa.array([x.replace("\n", " ").replace("\t", " ").replace("\r", " ") for x in texts], pa.large_string())
        split = pc.split_pattern(plain, " ")
        coded = split.flatten().dictionary_encode()
        if not len(coded):
            return [b""] * len(texts)
        ids = self._known(coded.dictionary.to_pylist())
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(ids), "<u4")
        at = coded.indices.to_numpy()
        n = sizes[at]
        ends = np.concatenate(([0], np.cumsum(n)))
        gathered = data[np.repeat(starts[at] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum(split.value_lengths().to_numpy())))]
        return [gathered[a:b].tobytes() for a, b in zip(bounds.tolist(), bounds[1:].tolist())]


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
