"""Encoding, counting and packing against the tokenizer libraries and brute force."""

import hashlib
import os
import random
from collections import defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from factorloom.llm import bpe, packing, token_counts
from tests.llm.samples import SF, STRANGE, documents, prose

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))


def noise(n: int) -> list[str]:
    rng = random.Random(7)
    alphabet = "aA bB.,'\n\t 0é́Σßñ日▁ \x1c<|>😀"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]


@pytest.fixture(scope="module")
def texts(spark):
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()]
    return STRANGE + noise(800) + real


def test_word_bpe_equals_library(texts):
    library, own = Tokenizer.from_file(WORD), bpe.Codec(WORD)
    for text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert own.encode(text or "") == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_long_words_merge_like_short_ones():
    own = bpe.Codec(WORD)
    rng = random.Random(1)
    for n in (1, 2, 3, 50, 400):
        parts = own.parts("".join(rng.choice("aethnos") for _ in range(n)))
        assert own.merge_long(list(parts)) == own.merge_short(list(parts))


def test_encoded_query_columns(spark):
    library = Tokenizer.from_file(WORD)
    rows = [*enumerate(STRANGE), (3, STRANGE[7]), (3, STRANGE[7]), (None, "x")]
    got = bpe.encoded(documents(spark, rows, ids="x", n_tokens=1), WORD, with_ids=True).collect()
    assert len(got) == len(rows)
    expected = set()
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        data = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids, skip_special_tokens=False)
        expected.add((i, len(ids), hashlib.sha256(data).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), data))
    assert {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, bytes(r.ids)) for r in got} == expected
    assert bpe.encoded(documents(spark, []), WORD).count() == 0


def test_counts_equal_sentencepiece(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    rows = list(enumerate(texts))
    # A small table of frequent pre-tokens, so that both tiers are used.
    got = token_counts.token_counts(documents(spark, rows, token="x", n=1), PIECE, limit=100, frequent=50).collect()
    assert len(got) == len(rows)
    for r in got:
        text = texts[r.doc_id] or ""
        assert (r.n_tokens, r.n_bytes) == (len(library.encode(text)), len(text.encode())), text
        assert r.over_limit == (r.n_tokens > 100)
    assert token_counts.token_counts(documents(spark, []), PIECE).count() == 0


def test_counts_of_a_json_file(spark):
    library = Tokenizer.from_file(WORD)
    got = token_counts.token_counts(documents(spark, list(enumerate(STRANGE))), WORD).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {
        i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(STRANGE)
    }


def test_byte_bpe_equals_library(texts):
    library, own = Tokenizer.from_file(BYTE), packing.ByteEncoder(BYTE)
    for text in texts:
        assert np.frombuffer(own.encode(text or ""), "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def check_plan(counts, capacity):
    ranks, bins = defaultdict(list), defaultdict(list)
    for length, low, high, first, per, offset in packing.plan(counts, capacity):
        for rank in range(low, high):
            ranks[length].append(rank)
            bins[first + (rank - low) // per].append((offset + (rank - low) % per * length, length))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(v)) for k, v in counts.items() if v}
    for items in bins.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
        assert sum(3 * length > capacity for _, length in items) <= 2
    return len(bins)


def best_fit_decreasing(counts, capacity):
    gaps = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [g for g in gaps if g >= length]
        if fits:
            gaps.remove(min(fits))
            gaps.append(min(fits) - length)
        else:
            gaps.append(capacity - length)
    return len(gaps)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_gapless_and_as_good_as_piece_by_piece(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 30, 64, 200])
    counts = {rng.randrange(1, capacity + 1): rng.randrange(0, 40) for _ in range(rng.randrange(1, 40))}
    n = check_plan(counts, capacity)
    assert n <= best_fit_decreasing(counts, capacity) + 1
    assert n * capacity >= sum(k * v for k, v in counts.items())


def test_plan_of_nothing():
    assert packing.plan({}) == []


def test_packing_places_every_piece(spark):
    rows = [*enumerate(STRANGE), (2, " "), (2, " "), (None, "x"), *((100 + i, prose(i, 40 * i)) for i in range(60))]
    library = Tokenizer.from_file(BYTE)
    expected = defaultdict(int)
    for i, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 512 else len(ids) % 512 or 512
        for piece, start in enumerate([0, *range(first, len(ids), 512)]):
            part = ids[start : first if not piece else start + 512]
            expected[i, piece, start, len(part), crc32(np.array(part, "<u4").tobytes())] += 1
    got = packing.best_fit(documents(spark, rows, length="x", salt=1, offset=2), BYTE, capacity=512).collect()
    seen, bins = defaultdict(int), defaultdict(list)
    for r in got:
        seen[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert seen == expected
    for items in bins.values():
        ends = [0, *(o + n for o, n in sorted(items))]
        assert [o for o, _ in sorted(items)] == ends[:-1] and ends[-1] <= 512
    assert packing.best_fit(documents(spark, []), BYTE).count() == 0
