"""Merkle manifest, toxicity and fill-in-the-middle against brute force, planted cases and round trips."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from factorloom.llm import fill_middle, merkle, toxicity
from tests.llm.samples import SCHEMA, SF, STRANGE, documents, prose

ROWS = [*enumerate(STRANGE), (3, STRANGE[3]), (5, STRANGE[5]), (5, STRANGE[5]), (None, "null id"), (None, None)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- manifest ---------------------------------------------------------------------------


def brute_tree(digests):
    """Root and, per leaf, its (before, after) at every level."""
    paths, owners, nodes = [[] for _ in digests], [[i] for i in range(len(digests))], list(digests)
    while len(nodes) > 1:
        up, up_owners = [], []
        for start in range(0, len(nodes), 3):
            run = nodes[start : start + 3]
            for k in range(len(run)):
                for leaf in owners[start + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            up_owners.append([leaf for o in owners[start : start + 3] for leaf in o])
        nodes, owners = up, up_owners
    return nodes[0] if nodes else None, paths


def brute_leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def brute_manifest(rows):
    """``rows`` of (doc_id, source, lang, n_chars, text); result as a sorted list of (doc_id, leaf, subroot, root, path)."""
    by_source = defaultdict(list)
    for row in rows:
        by_source[row[1]].append((row[0], brute_leaf(row)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        leaves = sorted(by_source[s], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[s] = (leaves, *brute_tree([leaf for _, leaf in leaves]))
    root, tops = brute_tree([trees[s][1] for s in order])
    return sorted(
        ((i, leaf, trees[s][1], root, path + tops[k]) for k, s in enumerate(order) for (i, leaf), path in zip(trees[s][0], trees[s][2])),
        key=str,
    )


def manifest_rows(rows):
    rng = random.Random(5)
    return [(i, rng.choice(["a", "a", "a", "é", "zz", None]), rng.choice(["en", None]), rng.choice([1, None]), t) for i, t in rows]


@pytest.mark.parametrize("levels", [1, 2, 6])
@pytest.mark.parametrize("n", [0, 1, 4, 60])
def test_manifest_equals_brute_force(spark, levels, n):
    rows = manifest_rows([*ROWS, *((100 + i, f"text {i}\n") for i in range(n))] if n > 1 else [(7, "only\n")][:n])
    df = spark.createDataFrame([(i, t, lang, s, c) for i, s, lang, c, t in rows], SCHEMA).withColumn("tree", F.lit("x")).withColumn("place", F.lit(1))
    tampered = F.when(F.col("doc_id") % 2 == 0, F.translate("text", "\n", ""))
    found = merkle.manifest(df, tampered, levels).persist()
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(w.before, w.after) for w in r.witness]) for r in found.collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    changed = {i for i, *_, t in rows if i is not None and i % 2 == 0 and t is not None and "\n" in t}
    for r in merkle.verified(found).collect():
        assert r.verified == (r.doc_id not in changed)
        assert r.verified == (r.folded_root == r.root)
    found.unpersist()


def test_one_source_of_several_blocks(spark):
    rows = [(i, "s", "en", 1, f"t{i}") for i in range(700)]
    df = spark.createDataFrame([(i, t, lang, s, c) for i, s, lang, c, t in rows], SCHEMA).repartition(7)
    got = [(r.doc_id, r.leaf, r.subroot, r.root, [(w.before, w.after) for w in r.witness]) for r in merkle.manifest(df, levels=2).collect()]
    assert sorted(got, key=str) == brute_manifest(rows)
    proofs = {r.doc_id: r.proof_sha256 for r in merkle.verified(merkle.manifest(df, levels=3)).collect()}
    assert proofs == {i: sha("".join(b + a for b, a in path)) for i, *_, path in brute_manifest(rows)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28, 80])
def test_stream_of_appends(n):
    digests = [sha(str(i)) for i in range(n)]
    stream = merkle.Stream(merkle.height(n))
    for d in digests:
        stream.append(d)
    stream.finish()
    root, paths = brute_tree(digests)
    assert stream.root == root
    assert [[(stream.left[k][i], stream.right[k][i]) for k in range(stream.height)] for i in range(n)] == paths


# --- fill in the middle -----------------------------------------------------------------


def brute_fill(doc_id, text, rate=100, spm=50, seed=7):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h[3] % 100 < spm:
        return len(lines), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(lines), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate", [100, 60])
@pytest.mark.parametrize("seed", range(20))
def test_scatter_and_gather_of_batches(seed, rate):
    rng = random.Random(seed)
    for _ in range(10):
        parts = ["a", "é", "\n", "<", "P", ">", "S", "M", "𝄞"]
        texts = ["".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 40]))) for _ in range(rng.randint(1, 12))]
        texts[rng.randrange(len(texts))] = None
        digests = [sha(f"7:{i}") for i in range(len(texts))]
        numbers = [np.array([int(d[8 * k : 8 * k + 8], 16) for d in digests]) for k in range(4)]
        measures, output, places = fill_middle.transform(*fill_middle.text_bytes(pa.array(texts, pa.string())), numbers, rate, 50)
        outputs = fill_middle.strings(output, places)
        want = [brute_fill(i, t, rate) for i, t in enumerate(texts)]
        assert list(zip(*(m.to_pylist() for m in measures), outputs.to_pylist())) == want
        forms = np.array([w[1] for w in want], dtype=object)
        assert fill_middle.strings(*fill_middle.restore(*fill_middle.text_bytes(outputs), forms)).to_pylist() == [t or "" for t in texts]


def test_fill_in_middle_of_strange_documents(spark, monkeypatch):
    monkeypatch.setattr(fill_middle, "SLICE_BYTES", 1000)
    rows = [*ROWS, (50, "a <P> b\nc"), (51, "<S\n>"), (52, "x\n" * 900 + "é"), (53, "\n")]
    df = documents(spark, rows, output="o", row=1, restored=2, h0=5)
    out = fill_middle.restored(fill_middle.fill_in_middle(df))
    assert {"lang", "row", "h0", "output", "restored"} <= set(out.columns)
    got = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.restored) for r in out.collect()]
    assert sorted(got, key=str) == sorted(((i, *brute_fill(i, t), t or "") for i, t in rows), key=str)
    assert fill_middle.restored(fill_middle.fill_in_middle(documents(spark, []))).count() == 0


# --- toxicity ---------------------------------------------------------------------------


def test_risk_turns_round_where_the_clean_risk_is_negative():
    up, down = toxicity.risk_slopes(np.array([0.0]), np.array([0.0]), 0.1)
    assert up[0] < 0 < down[0]
    up, down = toxicity.risk_slopes(np.array([9.0]), np.array([-9.0]), 0.5)
    assert up[0] > 0 > down[0]


def test_risk_slopes_are_those_of_the_risk():
    rng = np.random.default_rng(0)
    p, u, prior, e = rng.normal(size=5), rng.normal(size=7) + 1, 0.2, 1e-6
    up, down = toxicity.risk_slopes(p, u, prior)

    def risk(p, u):
        return prior * np.logaddexp(0, -p).mean() + np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()

    for i in range(5):
        assert up[i] == pytest.approx((risk(p + e * (np.arange(5) == i), u) - risk(p, u)) / e, abs=1e-4)
    for i in range(7):
        assert down[i] == pytest.approx((risk(p, u + e * (np.arange(7) == i)) - risk(p, u)) / e, abs=1e-4)


def test_planted_documents_are_found(spark):
    rng = random.Random(3)
    toxic = {i for i in range(600) if rng.random() < 0.15}
    rows = [(i, prose(i, 80) + (" vile Nasty!" if i in toxic else "") + prose(i + 9000, 40)) for i in range(600)]
    rows += [(1000 + k, t) for k, t in enumerate(STRANGE)] + [(None, "vile nasty"), (None, None), (7, rows[7][1])]
    labels = [(i, 1, int(i in toxic)) for i in range(600) if rng.random() < 0.6] + [(2, 0, None), (None, 1, 1), (5000, 1, 1)]
    labels = spark.createDataFrame(labels + labels[:9], "doc_id long, quality int, toxic int")
    found = toxicity.toxicity(documents(spark, rows, score=3, positive=1), labels).collect()
    assert len(found) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    from zlib import crc32

    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 600]
    assert sum(r.predicted == (r.doc_id in toxic) for r in held) >= 0.97 * len(held)
    assert len({r.score for r in found if r.doc_id in (1000, 1001)}) == 1


def test_held_out_labels_are_not_read(spark):
    docs = documents(spark, [(i, prose(i, 30) + (" vile" if i % 4 == 0 else "")) for i in range(200)])
    rows = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    inside = toxicity.remainder(F.col("doc_id")) == 0
    flipped = labels.withColumn("toxic", F.when(inside, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    first, second = ({r.doc_id: r.score for r in toxicity.toxicity(docs, x).collect()} for x in (labels, flipped))
    assert first == second


def test_toxicity_without_rows_or_positives(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(documents(spark, []), none).count() == 0
    assert {r.score for r in toxicity.toxicity(documents(spark, ROWS), none).collect()} == {0.0}


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.toxic for r in found) >= 0.95 * len(found)
