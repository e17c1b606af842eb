"""The batch scorer under lack of memory, and the incremental append."""

import duckdb
import numpy as np
import pytest

from tessera.operators import scorer
from tessera.streaming import runs


def test_halving():
    s = scorer.Overlap(100)
    first = ["a b c d e f g h i j"] * 9 + ["x" * 500]
    assert scorer.halving(s, first, ["a b"] * 10) == [0.2] * 9 + [0.0] and s.calls > 4
    with pytest.raises(MemoryError):
        scorer.halving(lambda a, b: (_ for _ in ()).throw(MemoryError()), ["a", "b"], None)
    with pytest.raises(RuntimeError, match="broken"):
        scorer.halving(lambda a, b: (_ for _ in ()).throw(RuntimeError("broken")), ["a", "b"], None)
    with pytest.raises(ValueError):
        scorer.halving(lambda a, b: [1], ["a", "b"], None)
    assert scorer.halving(s, [], None) == []


def test_scores_of_rows(spark):
    seen = []

    def make():
        def run(first, second):
            if len(first) > 3:
                raise MemoryError
            assert [len(a) for a in first] == sorted(map(len, first), reverse=True)  # longest first
            return [np.array([len(a), 1.0]) for a in first]

        return run

    rows = [(i, "w" * (i * 7 % 50) if i % 9 else None, 1) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, t string, extra int").repartition(3)
    got = {r.id: r.v for r in scorer.score(df, make, "t", size=16, kind="embed", name="v").collect()}
    assert got == {i: None if t is None else [len(t), 1.0] for i, t, _ in rows} and not seen
    said = scorer.score(df, lambda: lambda a, b: [x + "!" for x in a], "t", kind="generate", name="said").where("id = 1").first()
    assert said.said == "w" * 7 + "!" and said.extra == 1
    assert scorer.score(df.limit(0), make, "t").count() == 0


def test_batch_scores_equal_their_sql(spark, tmp_path):
    words = [f"{a}{b}" for a in "abcdefgh" for b in "abcdefghijklmnop"]
    texts = [" ".join(words), "aa", None, "x", "x \u0130stanbul \u212a", "istanbul k", " ".join(words[:64]), " ".join(words[:5]), "", "x"]
    rows = [(1, i, "user", t) for i, t in enumerate(texts)] + [(2, None, "user", "x"), (None, 0, "user", "x"), (None, 1, "user", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    run, sql = scorer.QUERIES["batch_scores"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    got = sorted(tuple(r) for r in run(spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(sql).fetchall()) and (1, 1, 0.007813) in got


def test_ids_are_appended_once(spark, tmp_path):
    schema = "event_id long, user_id long, event_type string, value double"
    put = lambda rows, name: spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
    put([(1, 1, "a", 1.0), (2, 1, "a", 2.0), (2, 1, "a", 2.0), (None, 1, "a", 0.0)], "x")
    first = runs.ingest(spark, f"{tmp_path}/in/", top=str(tmp_path / "top"))
    assert sorted(r.event_id for r in first.collect()) == [1, 2]
    put([(2, 9, "b", 9.0), (3, 1, "a", 3.0)], "y")
    second = runs.ingest(spark, f"{tmp_path}/in/", top=str(tmp_path / "top"))
    assert sorted((r.event_id, r.user_id) for r in second.collect()) == [(1, 1), (2, 1), (3, 1)]
    # a batch that runs again replaces its own rows
    again = spark.createDataFrame([(2, 9, "b", 9.0), (3, 1, "a", 3.0), (4, 1, "a", 4.0)], schema)
    runs.append_new(again, 1, str(tmp_path / "top/out"), "event_id")
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "top/out")).collect()) == [1, 2, 3, 4]
    assert runs.ingest(spark, f"{tmp_path}/in/", top=str(tmp_path / "top")).count() == 4  # nothing new
