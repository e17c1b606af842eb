"""The pipeline's near-dedup stage against all pairs by brute force."""

import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_groups(rows):
    sh = []
    for _, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sh.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = 0
    for i in range(len(rows)):
        for j in range(i):
            union = len(sh[i] | sh[j])
            if not union or Fraction(len(sh[i] & sh[j]), union) >= Fraction(4, 5):
                near += sh[i] != sh[j]
                parent[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return {i: least[find(k)] for k, (i, _) in enumerate(rows)}, near


@pytest.fixture
def rows():
    rng = random.Random(19)
    vocab = ["".join(rng.choices("aeiourstln", k=6)) for _ in range(400)]
    passage = " ".join(rng.choices(vocab, k=40))
    texts = [None, "", " ", "one two", "One two", "one two three"]
    for k in range(30):
        words = rng.choices(vocab, k=rng.randint(5, 120))
        for _ in range(rng.randint(1, 8)):
            words = list(words)
            for _ in range(rng.randint(0, 1 + len(words) // 40)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words if k % 3 else [*words, passage]))
    for k in range(60):  # about the threshold: a tenth of the shingles changed at the end
        words = rng.choices(vocab, k=94)
        texts += [" ".join(words), " ".join(words[: 94 - 8 - k % 5] + rng.choices(vocab, k=8 + k % 5))]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i * 2, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("frequent", [0, 100_000])
def test_groups_are_those_of_all_pairs(spark, rows, monkeypatch, frequent):
    monkeypatch.setattr(jaccard, "FREQUENT", frequent)
    want, near = brute_groups(rows)
    assert near > 50 and len(set(want.values())) > 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()} == want


def test_stage_keeps_one_of_each_group(spark, rows):
    want, _ = brute_groups(rows)
    more = [(None, rows[0][1]), rows[5], rows[5], (7001, "only here " * 9), (7001, "other text of that id " * 9), (7001, "only here " * 9), (None, "no id at all " * 9)]
    docs = spark.createDataFrame([(*r, k, "x") for k, r in enumerate([*rows, *more])], "doc_id long, text string, _i int, _First string")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns
    kept = [r.doc_id for r in got.collect()]
    assert sorted(kept, key=str) == sorted([*set(want.values()), 7001, 7001, None], key=str)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_simhash_proposes_pairs_with_few_changes(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choices("aeiourstln", k=6)) for _ in range(400)]
    texts = []
    for _ in range(30):
        words = rng.choices(vocab, k=900)
        texts += [" ".join(words), " ".join(["changed", *words[1:]])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert 20 <= jaccard.proposed(jaccard.sketches(docs).select("fp", "sim")).count() <= 30
    assert jaccard.first_documents(docs).count() == 30


def test_signatures_never_rule_out_what_is_shared():
    rng = np.random.default_rng(8)
    for n in (1, 9, 200, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) << np.uint64(1))
        y = np.unique(np.concatenate([x[: n // 2], rng.integers(0, 1 << 63, n // 2 + n // 7).astype(np.uint64)]))
        most = jaccard.may_share(jaccard.signature(x), jaccard.signature(y))
        assert len(np.intersect1d(x, y)) <= most <= len(x)
