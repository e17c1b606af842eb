"""Invented names against a walk in order, one after the other."""

import random

from pyspark.sql import functions as F

from tessera.operators import invented
from tessera.operators.questions import _deletions


def test_accepted_equals_a_walk(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choices("ab", k=3)) + "".join(rng.choices("abc", k=rng.randint(1, 4)))) for i in rng.sample(range(5000), 600)]
    seen, three, want = set(), {}, []
    for i, t in sorted(rows):
        if t[:4] not in seen and three.get(t[:3], 0) < 2:
            seen.add(t[:4])
            three[t[:3]] = three.get(t[:3], 0) + 1
            want.append(i)
    df = spark.createDataFrame(rows, "o long, token string").repartition(5)
    assert sorted(r.o for r in invented.accepted(df, "o", "token").collect()) == want and len(want) > 10


def test_tokens_are_the_same_in_any_partition(spark):
    got = [{r.id: r.t for r in spark.range(500).repartition(p).select("id", invented.tokens(F.col("id")).alias("t")).collect()} for p in (1, 7)]
    assert got[0] == got[1] and len(set(got[0].values())) > 450 and all(6 <= len(t) <= 10 and t[0].isupper() and t[1:].islower() for t in got[0].values())
    other = {r.id: r.t for r in spark.range(500).select("id", invented.tokens(F.col("id"), seed=7).alias("t")).collect()}
    assert sum(other[i] == got[0][i] for i in other) < 10


def test_rules_of_names(spark):
    named = [(1, "Brovelix", "drug"), (2, "Brovunar", "drug"), (3, "Brotamek", "drug"), (4, "Brokudel", "drug"), (5, "Grumolol", "drug"), (6, "Strngths", "drug"), (7, "Kadomel", "drug"), (8, "Kadumex syndrome", "disease"), (9, "Pelosanu", "drug"), (10, "Zitomar", "drug"), (11, None, "drug")]
    one = lambda col, *x: spark.createDataFrame([(w,) for w in x], f"{col} string")
    docs = spark.createDataFrame([(1, "we saw PELOSANU, once"), (2, None)], "doc_id long, text string")
    got = {r.order: r for r in invented.judged(spark.createDataFrame(named, "order long, name string, kind string"), one("word", "kadomal"), one("word", "fever"), docs, rejected=("zitomar",)).collect()}
    assert len(got) == len(named) and [i for i in sorted(got) if got[i].accepted] == [1, 3, 8]  # 2 shares four letters with 1, 4 is the third with bro
    assert not got[5].no_stem and not got[6].pronounceable and not got[7].far_from_drugs and not got[9].not_in_corpus and not got[10].not_rejected and not got[11].valid
    assert got[2].valid and got[4].valid and got[8].token == "kadumex"


def test_names_are_made_once_and_in_many_tasks(spark):
    sf = "/root/testdata/sf0.01"
    assert invented.random_tokens(spark, sf).rdd.getNumPartitions() > 1  # part is one row group
    assert "md5" not in invented.fabricated_names(spark, sf)._jdf.queryExecution().toString()  # rules read names, none makes them again
    forms = lambda w, n: spark.range(1).select(_deletions(F.lit(w), n).alias("f")).first().f
    assert len(forms("abcdef", 2)) == 1 + 6 + 15 and set(forms("aba", 2)) == {"aba", "ba", "aa", "ab", "a", "b"} and forms("", 2) == [""] and set(forms("ab", 3)) == {"ab", "a", "b", ""}
