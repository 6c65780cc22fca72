"""Near duplicates and repeated passages against brute force, and what recompression promises."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from factorloom.llm import minhash_dedup, substring_dedup
from factorloom.llm.components import components
from factorloom.llm.recompression import window_symbols
from factorloom.llm.word_hashes import WordHashes, windows
from tests.llm.samples import STRANGE, documents, prose

ROWS = [*enumerate(STRANGE), (3, STRANGE[3]), (5, STRANGE[5]), (5, STRANGE[5]), (None, "null id"), (None, None)]


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def edited(text, rng, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**9)}"
    return " ".join(words)


def shingle_set(text, size):
    words = words_of("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1)) or frozenset([tuple(words)])


def brute_near(rows, size):
    sets = [shingle_set(t, size) for _, t in rows]
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return Counter((doc, len(sets[i]), least.get(root(i)), doc == least.get(root(i))) for i, (doc, _) in enumerate(rows))


def near(spark, rows, size=4):
    got = minhash_dedup.near_duplicates(documents(spark, rows, digest="x", node=1, bands=2), size, 80).collect()
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got)


def test_near_equals_brute_force(spark):
    rng = random.Random(5)
    rows = list(ROWS)
    for group in range(6):
        text = prose(group, 30 + 40 * group, 1000)
        # Edits about the threshold, chains of edits, and a centre that is not the smallest id.
        rows += [(1000 - 100 * group + i, edited(text, rng, i % (3 + 2 * group))) for i in range(25)]
        chain = text
        for i in range(8):
            chain = edited(chain, rng, 1 + group // 2)
            rows.append((2000 + 10 * group + i, chain.upper()))
    rows += [(3000 + i, " ".join(rng.choice("ab") for _ in range(rng.randrange(1, 9)))) for i in range(60)]
    assert near(spark, rows) == brute_near(rows, 4)


def test_links_between_a_star_and_its_outsiders(spark):
    """Sets that pairwise share many buckets but link only along a path: the first centre does not reach all."""
    words = [f"w{i}" for i in range(260)]
    rows = [(50 - i, " ".join(words[6 * i : 6 * i + 100])) for i in range(20)]
    assert near(spark, rows) == brute_near(rows, 4)
    assert {c for _, _, c, _ in near(spark, rows)} == {31}


def test_near_copies_about_the_threshold_meet_seldom(spark, monkeypatch):
    """Copies of one origin that are just too far apart to link: after the stars fewer pairs than texts, and no link is lost."""
    rng = random.Random(11)
    text, verified, compared = prose(7, 150, 1000), minhash_dedup._verified, []

    def counting(pairs, *others):
        compared.append(pairs.count())
        return verified(pairs, *others)

    monkeypatch.setattr(minhash_dedup, "_verified", counting)
    rows = [(i, edited(text, rng, rng.randrange(1, 9))) for i in range(240)]
    # Half of the texts share edits, so some links run between nodes that do not link with the centre.
    rows += [(1000 + i, edited(rows[i][1], rng, rng.randrange(1, 4))) for i in range(0, 240, 2)]
    expected = brute_near(rows, 4)
    assert 20 < len({c for _, _, c, _ in expected}) < 300
    assert near(spark, rows) == expected
    assert sum(compared[1:]) < len(rows)


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_pairs_across_components_hold_every_link(spark, percent):
    """Random sets about a few centres, in components drawn at random: whatever links within a star meets."""
    rng = np.random.default_rng(percent)
    base = rng.integers(1, 2**63, 40, dtype=np.uint64)
    sets = {n: np.unique(np.concatenate([rng.permutation(base)[: rng.integers(20, 40)], rng.choice(base + np.uint64(1), 6)])) for n in range(60)}
    sets[58], sets[59] = np.append(sets[57], np.uint64(0)), sets[57][1:]
    part = {n: n if n % 3 else 0 for n in sets}
    star = [(c, len(sets[c]), n, len(sets[n])) for c in (0, 1) for n in sets if n > 1]
    got = minhash_dedup._across(
        spark.createDataFrame(star, "centre long, n_centre long, node long, n_shingles long"),
        spark.createDataFrame(list(part.items()), "node long, component long"),
        spark.createDataFrame([(n, bytearray(np.sort(x).astype("<u8").tobytes())) for n, x in sets.items()], "node long, hashes binary"),
        percent,
    )
    linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= percent * len(np.union1d(sets[a], sets[b]))
    across = {(a, b) for a in sets for b in sets if 1 < a < b and part[a] != part[b] and linked(a, b)}
    # Pairs that need no shared difference link through the centre.
    apart = {(a, b) for a, b in across if not any(linked(a, c) and linked(b, c) for c in (0, 1))}
    assert apart <= {(r.a, r.b) for r in got.collect()}
    assert len(apart) > 0 or percent == 100


def test_near_of_nothing_and_of_copies(spark):
    assert near(spark, []) == Counter()
    assert near(spark, [(1, ""), (2, None), (3, " ")]) == Counter({(i, 0, i, True): 1 for i in (1, 2, 3)})
    rows = [(i, "a b c d e f") for i in range(500)]
    assert near(spark, rows) == brute_near(rows, 4)


def test_representatives_keep_one_row_each(spark):
    text = prose(1, 200)
    rows = [(4, text), (2, text + " x"), (2, text + " x"), (9, prose(2, 200)), (None, "alone"), (7, "")]
    docs = documents(spark, rows, row="r", kept_id=1, row_key=3)
    got = minhash_dedup.representatives(docs)
    assert got.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in got.collect()) == sorted(
        [("2", text + " x"), ("9", rows[3][1]), ("7", ""), ("None", "alone")]
    )


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for size in (3, 40, 3000):
        pool = rng.integers(0, 2**64, 2 * size, dtype=np.uint64)
        share = []
        for _ in range(60):
            own = rng.permutation(pool)
            a, b = np.unique(own[:size]), np.unique(own[size // 3 : size // 3 + size])
            common = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            same = np.mean(minhash_dedup.signature(a, 200) == minhash_dedup.signature(b, 200))
            share.append(same - common)
        assert abs(np.mean(share)) < 0.05


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_passages(rows, window):
    least = {}
    for i, text in rows:
        words = words_of(text)
        for p in range(len(words) - window + 1):
            if i is not None:
                key = tuple(words[p : p + window])
                least[key] = min(i, least.get(key, i))
    out = Counter()
    for i, text in rows:
        words = words_of(text)
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and least[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = " ".join(w for j, w in enumerate(words) if j not in gone)
        out[i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def passages(spark, rows, window):
    got = substring_dedup.substring_dedup(spark, documents(spark, rows, name="x", shared=1, removed=2), window).collect()
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got)


def test_passages_equal_brute_force(spark):
    rng = random.Random(9)
    shared = [prose(s, n, 5000) for s, n in ((1, 49), (2, 50), (3, 51), (4, 80), (5, 300))]
    rows = list(ROWS)
    for i in range(60):
        parts = [rng.choice([prose(100 + 7 * i + k, rng.randrange(5, 90), 5000), rng.choice(shared)]) for k in range(5)]
        rows.append((rng.randrange(500), " ".join(parts)))
    # Runs and periods of many lengths, copies, near copies, and one id with several texts.
    rows += [(600 + n, "x " * n) for n in (10, 49, 50, 51, 120)] + [(620 + n, "p q " * n) for n in (24, 25, 40, 70)]
    rows += [(650, "y " * 60 + prose(8, 40)), (651, prose(9, 30) + " y" * 75), (652, "a b c " * 30 + "a b"), (653, "z " + "a b c " * 25)]
    rows += [(700, shared[4]), (701, shared[4]), (699, shared[4] + " end"), (701, "start " + shared[4]), (702, "  " + shared[4].replace(" ", "\n"))]
    rows += [(None, shared[3]), (None, "q " + shared[4])]
    rows += [rows[-8], rows[-8]]
    assert passages(spark, rows, 50) == brute_passages(rows, 50)


@pytest.mark.parametrize("window", [20, 33])
def test_passages_of_few_different_words(spark, window):
    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice(["a", "b"][: 1 + (rng.random() < 0.1)]) for _ in range(rng.randrange(10, 120)))) for i in range(80)]
    assert passages(spark, rows, window) == brute_passages(rows, window)


def test_passages_of_nothing(spark):
    assert passages(spark, [], 50) == Counter()


def test_equal_windows_have_one_symbol():
    """The promise behind the candidates: the same symbol stands for a window wherever its words stand."""
    rng = random.Random(2)
    hashes = WordHashes()
    for size in (2, 60):
        inside = [f"w{rng.randrange(size)}".encode() for _ in range(70)]
        documents, places = [], []
        for _ in range(40):
            before = [f"w{rng.randrange(size)}".encode() for _ in range(rng.randrange(60))]
            after = [f"w{rng.randrange(size)}".encode() for _ in range(rng.randrange(60))]
            documents.append(hashes.of(before + inside + after))
            places.append(len(before))
        for several in (documents, documents[:1], documents[5:9]):
            document, first, end, name, known = window_symbols(several, 50)
            stands = {}
            for d, a, b, n, k in zip(document.tolist(), first.tolist(), end.tolist(), name.tolist(), known.tolist()):
                for p in range(a, b):
                    assert (d, p) not in stands
                    stands[d, p] = n if k else None
            assert len(stands) == sum(len(d) - 49 for d in several)
            offset = 0 if several[0] is documents[0] else 5
            seen = {tuple(stands[d, places[d + offset] + i] for i in range(21)) for d in range(len(several))}
            assert len(seen) == 1
            assert size == 2 or next(iter(seen)).count(None) < 10


def test_window_names_depend_on_every_word():
    rng = np.random.default_rng(3)
    names = rng.integers(0, 2**64, 200, dtype=np.uint64)
    for size in (1, 2, 7, 50):
        out = windows(names, size)
        assert len(out) == 201 - size
        for i in (0, size // 2, size - 1):
            other = names.copy()
            other[100 + i] ^= np.uint64(1)
            changed = np.flatnonzero(windows(other, size) != out)
            assert changed.tolist() == list(range(100 + i - size + 1, 100 + i + 1))


def test_a_large_group_about_the_threshold(spark):
    """Edited copies of one text, most of them too far apart to link, some edited in the same places, beside shorter and longer texts."""
    rng = random.Random(11)
    text = prose(7, 150, 5000)
    shared = edited(text, rng, 6)
    rows = [(i, edited(text if i % 3 else shared, rng, i % 11)) for i in range(300)]
    rows += [(400 + i, " ".join(text.split(" ")[: 30 + i])) for i in range(0, 120, 4)]
    rows += [(600 + i, edited(text, rng, 9) + " " + prose(i, 1500)) for i in range(5)]
    got = near(spark, rows)
    assert got == brute_near(rows, 4)
    assert 20 < len({c for _, _, c, _ in got}) < 200
