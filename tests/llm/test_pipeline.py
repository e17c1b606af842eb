import collections
import random
import zlib

import pytest
from test_near_dedup import brute_groups
from test_operators import BYTE, brute_lines, brute_verdict, le32, library
from test_secrets import brute as brute_spans

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns_and_pieces_are_whole(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    cols, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        assert docs.columns == cols
        seen.append(docs.count())
    assert 200 > seen[0] >= seen[1] > seen[2] == seen[3] > 100
    got = corpus_pipeline.run(spark, SF).collect()
    parts = collections.defaultdict(int)
    for r in got:
        parts[r.doc_id] += r.length
    assert len(parts) == seen[3] and all(parts[r.doc_id] == r.doc_tokens for r in got)


def expected(rows):
    """The whole pipeline by brute force: (doc_id, text) that reach packing."""
    rows = [(i, t) for i, t in rows if brute_verdict(t)]
    cut = brute_lines(rows)
    rows = [(i, cut[i][1]) for i, t in rows if not cut[i][0] or cut[i][1].split()]
    stays = set(brute_groups(rows)[0].values())
    out = []
    for i, t in rows:
        if i in stays:
            clean, at = [], 0
            for kind, s, e in brute_spans(t):
                if s >= at:
                    clean += [t[at:s], f"[{kind}]"]
                at = max(at, e)
            out.append((i, "".join([*clean, t[at:]])))
    return out


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(23)
    vocab = ["".join(rng.choices("aeiourstln", k=rng.randint(2, 9))) for _ in range(500)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    footer = "\n".join(say(9) for _ in range(4))
    texts = [None, "", "few words", "SHOUT " * 40, "# | % " * 40, "again and again " * 40]
    for k in range(40):
        body = "\n".join(say(rng.randint(5, 15)) for _ in range(rng.randint(3, 9)))
        texts.append(body + ("\n" + footer if k % 3 == 0 else ""))
        if k % 4 == 0:
            texts.append(body.replace(" ", "  ", 1))  # near: same words, other lines
        if k % 5 == 0:
            words = body.split(" ")
            words[len(words) // 2] = "changed"
            texts.append(" ".join(words))
        if k % 6 == 0:
            texts.append(say(60) + f"\npassword = s3cretValue{k:06d} AKIA{'Q7' * 8} eyJ{'ab' * 9}.eyJ{'cd' * 9}.{'ef' * 5} end\n" + say(30))
    texts.append("\n".join(say(8) for _ in range(5000)))  # one long text of many lines
    texts.append(texts[-1] + "\nand a tail of its own that no other text has at all")
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(3 * i + 1, texts[k]) for i, k in enumerate(order)]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "own") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, length string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    want = expected(rows)
    assert 40 < len(want) < len(rows) - 5 and any("[assign]" in t for _, t in want)
    ids, _ = library(BYTE, [t for _, t in want])
    whole = {i: [*x, 1] for (i, _), x in zip(want, ids)}
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    parts, held = collections.defaultdict(int), collections.Counter()
    for r in got:
        assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(le32(whole[r.doc_id][r.start : r.start + r.length])), r.doc_id
        parts[r.doc_id] += r.length
        held[r.sequence_id] += r.length
    assert dict(parts) == {i: len(x) for i, x in whole.items()} and max(held.values()) <= 2048


def test_run_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
