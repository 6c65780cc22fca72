"""Byte-pair encoding and decoding with word ends, from a public tokenizer file.

A text is cut at special strings, then at blanks; a chunk is normalised (NFC, lower case), cut into words by the file's pattern, and
every word is merged on its own. A short word holds its part boundaries and the ranks of adjacent parts in contiguous arrays: the
minimum rank is looked up, its boundary deleted and the neighbouring ranks refreshed, until no pair has a rank. Words beyond
``LONG`` bytes use a heap of ranked pairs instead, so an unbroken text of any length costs ``n log n``. Chunks go through a
bounded cache per Python worker.

Defined cases: a null text counts as empty and has no tokens; rows are independent, so repeated rows give repeated results; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from factorloom.llm.shared import map_rows

LONG = 256
CACHED_CHUNKS = 300_000
CACHED_LENGTH = 40
NONE = 1 << 30
# The blanks of the file's pattern, which are Unicode's White_Space.
WHITE_SPACE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
BLANKS = re.compile("[" + "".join(map(chr, WHITE_SPACE)) + "]+")
SEPARATORS = re.compile("[\x1c-\x1f]")  # blanks for str.split, but not in Unicode


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable Latin-1 as it is, the rest from U+0100 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(others)) for b in range(256)]


class Codec:
    """Encoder and decoder of one tokenizer file with NFC, lower case, a splitting pattern and a word-end suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: another kind of tokenizer")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", r"\p{White_Space}")
        self.words = regex.compile(pattern).findall
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        letters = byte_letters()
        self.inner = [vocab[c] for c in letters]
        self.final = [vocab[c + suffix] for c in letters]
        self.pairs: dict[int, int] = {}  # left id and right id -> rank
        self.merged: list[int] = []  # rank -> id
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.merged.append(vocab[left + right])
        names = vocab | self.special
        self.names = [""] * (max(names.values()) + 1)
        for name, i in names.items():
            self.names[i] = name
        self.chunks: dict[str, tuple[int, ...]] = {}

    def parts(self, word: str) -> list[int]:
        data = word.encode()
        return [*map(self.inner.__getitem__, data[:-1]), self.final[data[-1]]]

    def merge_short(self, parts: list[int]) -> list[int]:
        get, merged = self.pairs.get, self.merged
        ranks = [get(a << 20 | b, NONE) for a, b in zip(parts, parts[1:])]
        while ranks:
            rank = min(ranks)
            if rank == NONE:
                break
            i = ranks.index(rank)
            parts[i] = new = merged[rank]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, NONE)
        return parts

    def merge_long(self, parts: list[int]) -> list[int]:
        get = self.pairs.get
        n = len(parts)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := get(parts[i] << 20 | parts[i + 1], NONE)) != NONE]
        heapq.heapify(heap)
        while heap:
            rank, i = heapq.heappop(heap)
            j = right[i]
            if parts[i] < 0 or j < 0 or get(parts[i] << 20 | parts[j], NONE) != rank:
                continue
            parts[i], parts[j] = self.merged[rank], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a in (left[i], i):
                if a >= 0 and right[a] >= 0 and (r := get(parts[a] << 20 | parts[right[a]], NONE)) != NONE:
                    heapq.heappush(heap, (r, a))
        return [p for p in parts if p >= 0]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        # Lower case letter by letter: str.lower alone would treat a final capital sigma by its context.
        plain = unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower()
        ids: list[int] = []
        for word in self.words(plain):
            parts = self.parts(word)
            ids += self.merge_short(parts) if len(parts) <= LONG else self.merge_long(parts)
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        cache = self.chunks
        for piece in self.cut.split(text) if "<|" in text else (text,):
            if piece in self.special:
                ids.append(self.special[piece])
                continue
            for chunk in BLANKS.split(piece) if SEPARATORS.search(piece) else piece.split():
                got = cache.get(chunk)
                if got is None:
                    got = self.encode_chunk(chunk)
                    if len(chunk) <= CACHED_LENGTH:
                        if len(cache) >= CACHED_CHUNKS:
                            cache.clear()
                        cache[chunk] = got
                ids += got
        return ids

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens stand side by side with a space between."""
        return " ".join(map(self.names.__getitem__, ids))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every whole text, and on demand ``ids`` as little-endian bytes."""
    source = docs.select("doc_id", "text")

    def rows() -> Callable[..., Iterator[tuple]]:
        own = codec(path)

        def one(doc_id, text):
            ids = own.encode(text or "")
            data = np.array(ids, "<u4").tobytes()
            text = own.decode(ids)
            out = (doc_id, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
            yield (*out, data) if with_ids else out

        return one

    fields = [source.schema["doc_id"], StructField("n_tokens", LongType())]
    fields += [StructField(n, StringType()) for n in ("ids_sha256", "decoded_sha256")]
    schema = StructType(fields).add("ids", "binary") if with_ids else StructType(fields)
    return map_rows(source, rows, schema)
