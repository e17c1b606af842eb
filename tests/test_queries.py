"""Every query with SQL against DuckDB, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from tessera import registry
from tessera.plans.core import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(df, cols):
    def said(x):
        if x is None or (isinstance(x, float) and np.isnan(x)):
            return "null"
        return f"{x:.8g}" if isinstance(x, (float, np.floating)) else str(x)

    return sorted(tuple(map(said, r)) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_duckdb(spark, duck, name):
    got, want = registry.queries()[name](spark, SF).toPandas(), duck.sql(registry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert canonical(got, cols) == canonical(want, cols)


def test_plans_take_other_inputs(spark):
    from tessera.operators import runs

    df = spark.createDataFrame([("m", 1.0, 10, None), ("m", 3.0, 30, 0.5)], "model string, seconds double, gen_tokens long, top_rerank_score double")
    row = runs.QUERIES["efficiency"][0].run(spark, runs=df).first()
    assert (row.mean_s, row.tok_s, row.excluded) == (2.0, 10.0, 1)


def test_functions(spark):
    from pyspark.sql import functions as F

    from tessera.functions import responses as R
    from tessera.functions.prompts import IDK

    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    cites = [("[1, 2, 3, 4]", [1, 2, 3, 4]), ("[0, 1, 3, 99]", [1, 3]), ("[2, 2, 4][4]", [2, 4]), ("none", []), ("[2][3][4]", [2, 3, 4]), ("so. Evidence: 2 and 4\n5", [2, 4]), ("[see 3]", [3])]
    for s, want in cites:
        assert one(R.parse_citations(F.lit(s), 5)) == want
    assert one(R.last_answer(F.lit("Answer: A then **Answer: C** or answer Z"))) == "C"
    assert one(R.last_answer(F.lit("no"))) is None
    four, three = ({k: f"text {k}" for k in "ABCD"}, {"A": "yes", "B": "no", "C": "maybe"})
    for s, options, want in [
        ("**B. Some text**", four, "B"), ("**B.**", four, "B"), ("Answer: C. maybe", four, "C"), ("Answer: yes", three, "A"), ("None of the options are correct", four, None),
        ("Answer: None of the options are correct", four, None), ("Answer: D", four | {"D": IDK}, "ABSTAIN"), (IDK, four, "ABSTAIN"), ("(c)", four, "C"), ("answer: text b", four, "B"),
    ]:
        assert one(R.parse_answer(F.lit(s), F.create_map(*[F.lit(x) for kv in options.items() for x in kv]))) == want, s
    assert one(R.close_think(F.lit("<think>a"))) == "<think>a\n</think>" and one(R.close_think(F.lit("<Think>a</think>"))) == "<Think>a</think>"
    assert [one(R.final_segment(F.lit(s))) for s in ("<think>a</think>b</THINK> c", "<think>a", "a", "")] == [" c", "", "a", ""]
    assert one(R.strip_think(F.lit(" <think>a\n</think> b </think>"))) == "b"
    assert [one(R.final_cites(F.lit(s))) for s in ("Evidence: [1]</think>Evidence: [3], [2] and x", "x [1]")] == [[2, 3], None]
    assert [one(R.verbal_abstention(F.lit(s))) for s in ("Answer: **None** of", "Cannot say", "Answer: B", None)] == [True, True, False, False]
    assert [one(R.loop_suspect(F.lit(s))) for s in ("ab" * 500, "ab", "".join(chr(97 + i * i * 7 % 26) + str(i * 7919) for i in range(200)))] == [True, False, False]
    assert [one(R.format_p(F.lit(p).cast("double"))) for p in (None, 0.0, 0.00012, 0.04)] == ["n/a", "< 1e-300", "1.20e-04", "0.04000"]
    for s, kind in [("hi!", "greeting"), ("", "unclear"), ("is it", "unclear"), ("my baby has a fever", "pregnancy_child"), ("can I take two tablets", "medicine_safety"), ("how to stop the bleeding", "treatment"), ("I have a bad cough", "symptoms"), ("what is a virus really", "general_info")]:
        assert one(R.question_type(F.lit(s))) == kind, s
    assert one(R.question_type(F.lit("unconscious"), emergency=True)) == "symptoms"


def test_gates_fail_where_they_should(spark):
    from tessera.operators import responses as O

    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    chunks = spark.createDataFrame([(1, "a"), (1, "a")], "doc_id long, chunk_id string")
    vectors = spark.createDataFrame([(1, [0.0, 1.0]), (2, [float("nan"), 0.0])], "vec_id long, embedding array<double>")
    got = {r.gate: r.ok for r in O.gate_index(docs, chunks, vectors).collect()}
    assert not (got["chunks_cover_documents"] or got["chunk_ids_unique"] or got["vectors_finite"])
    words = " ".join(f"w{i}" for i in range(15))
    train = spark.createDataFrame([(words,)], "text string")
    test = spark.createDataFrame([(1, words, "short"), (2, "other", words[:30])], "item_id long, question string, options string")
    assert {r.field: (r.contaminated, r.ok) for r in O.audit_ngram(train, test).collect()} == {"question": (1, False), "options": (0, True)}
    with pytest.raises(ValueError):
        O.refuse_shards(["/a/b.jsonl", "/a/run_shard1.jsonl"])
    assert O.refuse_shards(["/a_shard/b.jsonl"]) == ["/a_shard/b.jsonl"]


def test_sources(spark, tmp_path):
    from tessera.sources import jsonl

    (tmp_path / "a.jsonl").write_text('{"id": 1}\n\n{"id": 2}\n')
    assert sorted(r.id for r in jsonl.read_jsonl(spark, str(tmp_path / "a.jsonl"), "id int").collect()) == [1, 2]
    assert jsonl.manifest(spark, str(tmp_path / "a.jsonl")).first().bytes == 21
    (tmp_path / "run.log").write_text("start\nqwen3-1.7b    DONE 0.51 0.62 100/100 0.1192/0.7009\nend\n")
    (tmp_path / "other.log").write_text("nothing here\n")
    assert [tuple(r) for r in jsonl.log_rates(spark, f"{tmp_path}/*.log").collect()] == [("qwen3-1.7b", 0.1192, 0.7009)]
    a, b = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(2,), (3,)], "id int")
    merged, report = jsonl.shard_report([a, b], 3)
    assert merged.count() == 4 and tuple(report.first()) == (4, 2, 1, False)


def test_red_flags_equal_their_sql_whatever_a_turn_says(spark, tmp_path):
    rows = [(c, t, "user", x) for c in (None, *range(-5, 10)) for t, x in enumerate(("some bleeding", "not pregnant\nfits", "no. chest pain", "", None))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = registry.queries()["red_flags"](spark, str(tmp_path)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, con.sql(registry.oracle_sql()["red_flags"]).fetchall()))


def test_missing_ids_need_no_window(spark):
    plan = registry.queries()["missing_unexpected_ids"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Rank" not in plan


def test_emergency():
    from tessera.functions.emergency import first_flag

    for text, want in (
        ("She has chest pain", "Chest pain"),
        ("no fever, chest  pain since noon", "Chest pain"),
        ("He denies any kind of chest pain", None),
        ("denies this and also those other things that chest pain", "Chest pain"),
        ("absence of the usual kind of chest pain", None),
        ("pregnant with swelling and a headache", "Pregnancy with swelling and headache"),
        ("my 2 month old baby has fever", "Infant under 3 months with fever"),
        ("baby is 5 months old with fever", None),
        ("fever and headache", None),
        ("", None),
        (None, None),
    ):
        assert first_flag(text) == want, text


def test_nearest_words_and_phrases(spark):
    from tessera.operators.questions import min_levenshtein, phrase_hits

    tokens = spark.createDataFrame([("kitten",), ("a",), ("",), ("zzzzzz",), ("sitting",)], "token string")
    words = spark.createDataFrame([("sitten",), ("mitten",), ("sitting",), ("b",)], "word string")
    assert {r.token: r.distance for r in min_levenshtein(tokens, words).collect()} == {"kitten": 1, "a": 1, "": 1, "zzzzzz": 3, "sitting": 0}
    docs = spark.createDataFrame([(1, "The Foo-bar (v2) is"), (2, "foo-bars"), (3, None), (4, "xfoo-bar")], "doc_id long, text string")
    got = phrase_hits(spark.createDataFrame([("foo-bar",), ("the foo",)], "phrase string"), docs)
    assert {r.phrase: r.hits for r in got.collect()} == {"foo-bar": 1, "the foo": 1}


def test_thresholds_match_brute_force(spark):
    import random

    from tessera.operators.calibration import QUERIES

    rng = random.Random(5)
    rows = [(f"m{k}", s, rng.random() < 0.4, round(rng.random(), 2 + 2 * k), rng.random() < 0.6) for k in range(3) for s in ("validation", "test") for _ in range(120)]
    rows += [("none", "validation", False, 0.5, True)] * 3 + [("all", "validation", True, 0.2, True)] * 3
    df = spark.createDataFrame(rows, "model string, split string, should_abstain boolean, confidence double, correct boolean")
    f1, conformal = ({r.model: r.tau for r in QUERIES[q][0].run(spark, answers=df).collect()} for q in ("tune_tau_f1", "conformal_tau"))
    grid = {(r.model, r.k): (r.coverage, r.accuracy) for r in QUERIES["risk_cov_grid"][0].run(spark, answers=df).collect()}
    for m in ("m0", "m1", "m2", "none", "all"):
        val, test = ([(r[2], r[3], r[4]) for r in rows if r[:2] == (m, s)] for s in ("validation", "test"))
        best = None
        for tau in sorted({0.0, 1.0, *[c for _, c, _ in val]}):
            tp, fp, fn = (sum(u == x and (c < tau) == y for u, c, _ in val) for x, y in ((True, True), (False, True), (True, False)))
            got = (tp / (tp + fn / 2 + fp / 2) if tp else 0, tp / (tp + fp) if tp else 0)
            if best is None or got[0] > best[0] + 1e-9 or abs(got[0] - best[0]) < 1e-9 and got[1] > best[1]:
                best = (*got, tau)
        assert f1[m] == best[2], m
        answerable, others = ([1 - c for u, c, _ in val if u == x] for x in (False, True))
        allowed = [(sum(s >= t for s in others), -sum(s >= t for s in answerable), -t) for t in {1 - c for _, c, _ in val} if answerable and sum(s >= t for s in answerable) <= 0.05 * len(answerable)]
        assert conformal[m] == (None if not answerable else -max(allowed)[2] if allowed else 1.0), m
        for k in range(51 if test else 0):
            kept = [(u, ok) for u, c, ok in test if 1 - c < k / 50]
            gold = [ok for u, ok in kept if not u]
            assert grid[m, k] == (round(len(kept) / len(test), 9), round(sum(gold) / len(gold), 9) if gold else 0.0), (m, k)


def test_temperature_and_quantiles(spark):
    from tessera.operators.calibration import QUERIES

    probs = [("sharp", "validation", "A", 0.4, 0.3, 0.2, 0.1)] * 5 + [("flat", "validation", g, 0.97, 0.01, 0.01, 0.01) for g in "ABCD"] + [("even", "validation", "A", 0.25, 0.25, 0.25, 0.25)]
    df = spark.createDataFrame(probs, "model string, split string, gold string, a double, b double, c double, d double")
    assert {r.model: r.t for r in QUERIES["fit_temperature"][0].run(spark, probs=df).collect()} == {"sharp": 0.1, "flat": 30.0, "even": 1.0}
    scores = [0.5, None, 0.1, 0.1, 0.9, 0.3, 0.7] * 9 + [0.2]
    runs = spark.createDataFrame([("m", "validation", s) for s in scores], "model string, split string, top_rerank_score double")
    x = sorted(s for s in scores if s is not None)
    want = sorted({x[round(i / 100 * (len(x) - 1))] for i in range(101)} | {round(x[-1] + 0.01, 9)})
    assert sorted(r.tau for r in QUERIES["quantile_grid"][0].run(spark, runs=runs).collect()) == want


def test_negations_in_one_pass():
    from tessera.functions.emergency import Negations

    for before, want in (("no a b c d e ", True), ("no a b c d e f ", False), ("free of a b c d e f ", True), ("free of a b c d e f g ", False), ("carefree of ", True), ("no, ", False), ("no but ", False), ("never a, but without ", True), ("", False)):
        assert Negations(before + "fever").cover(len(before)) is want, before
