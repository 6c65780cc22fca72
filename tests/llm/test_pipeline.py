"""The pipeline: what each stage may do to its own input, on awkward rows and on the smallest table."""

from collections import Counter, defaultdict

import public_tokenizers
import pytest

import corpus_pipeline
from factorloom.llm import packing, quality_rules, secret_scan
from factorloom.llm.shared import stored
from tests.llm.samples import STRANGE, documents, prose
from tests.llm.test_duplicates import shingle_set
from tests.llm.test_texts import line_key


def stages(spark, docs, sf_dir):
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stored(stage(spark, tables[-1], sf_dir), "test"))
    return tables


def check(tables):
    docs, good, lined, single, clean, packed = ([r.asDict() for r in t.collect()] for t in tables)
    for before, after in zip(tables, tables[1:5]):
        assert after.columns == before.columns
    passes = [r for r in docs if quality_rules.measure(r["text"])[0] >= 20]
    assert len(good) <= len(passes)
    holders = defaultdict(set)
    for r in good:
        for line in r["text"].split("\n"):
            holders[line_key(line)].add((r["doc_id"], r["text"]))
    expected = Counter(
        (r["doc_id"], "\n".join(x for x in r["text"].split("\n") if not line_key(x) or len(holders[line_key(x)]) < 10)) for r in good
    )
    assert Counter((r["doc_id"], r["text"]) for r in lined) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in lined + single + clean)
    kept = Counter((r["doc_id"], r["text"]) for r in single)
    assert max(kept.values(), default=1) == 1 and set(kept) <= {(r["doc_id"], r["text"]) for r in lined}
    sets = [shingle_set(r["text"], 5) for r in single]
    for i, a in enumerate(sets):
        for b in sets[:i]:
            assert not a or 100 * len(a & b) < 80 * len(a | b)
    find = secret_scan.scanner()
    assert len(clean) == len(single)
    same = {r["doc_id"]: r["text"] for r in single}
    for r in clean:
        assert not [s for s in find(r["text"]) if s[1] in (1, 2)]
        if not find(same[r["doc_id"]]):
            assert r["text"] == same[r["doc_id"]]
    own = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert sum(r["length"] for r in packed) == sum(len(own.encode(r["text"])) // 4 + 1 for r in clean)
    bins = defaultdict(int)
    for r in packed:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values(), default=0) <= 2048


def test_stages_on_awkward_rows(spark):
    shared = "All rights reserved"
    rows = [*enumerate(STRANGE), (3, STRANGE[3]), (None, prose(99, 80))]
    rows += [(100 + i, f"{prose(i, 60 + i)}\n{shared}\nkey AKIA1234567890ABCDE{i % 10} token=abc{i}def") for i in range(30)]
    rows += [(200 + i, f"{prose(i, 60 + i)} tail\n {shared.upper()} ") for i in range(30)]
    rows += [(300, prose(1, 70)), (300, prose(1, 70)), (301, "| " * 60)]
    check(stages(spark, documents(spark, rows, row="r", kept=1, failures=2), None))


def test_stages_on_the_smallest_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    tables = stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
    check(tables)
    whole = corpus_pipeline.run(spark, sf_dir)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(map(tuple, whole.select(columns).collect())) == Counter(map(tuple, tables[-1].select(columns).collect()))


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_stages_of_nothing(spark, rows):
    assert stages(spark, documents(spark, rows), None)[-1].count() == 0
