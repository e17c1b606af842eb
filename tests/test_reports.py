"""Configs, path resolution, table sinks and archives."""

import tarfile

import pytest

from tessera.sources import jsonl, reports


def test_config_and_paths(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"seed": 42, "index": {"max_words": 350}}')
    assert reports.load_config(spark, f"{tmp_path}/a.json")["index"]["max_words"] == 350
    yaml = pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text(yaml.dump({"seed": 7}))
    assert reports.load_config(spark, f"{tmp_path}/a.yaml") == {"seed": 7}
    assert reports.first_path(spark, f"{tmp_path}/no", f"{tmp_path}/a.json", f"{tmp_path}/a.yaml") == f"{tmp_path}/a.json"
    assert reports.first_path(spark, f"{tmp_path}/no") is None
    (tmp_path / "old1.jsonl").write_text('{"id": "1", "model": "m-old"}\n')
    (tmp_path / "old2.jsonl").write_text('{"id": "2"}\n')
    paths = [[f"{tmp_path}/new.jsonl"], [f"{tmp_path}/old1.jsonl", f"{tmp_path}/old2.jsonl"]]
    assert sorted(map(tuple, reports.model_rows(spark, paths, "id string, model string", ["m", "m-old"]).collect())) == [("1", "m-old"), ("2", "m")]
    with pytest.raises(Exception, match="model not in"):
        reports.model_rows(spark, paths, "id string, model string", ["other"]).collect()
    with pytest.raises(FileNotFoundError):
        reports.model_rows(spark, paths[:1], "id string, model string", ["m"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.5, 'say "x"'), ("c|d_e", None, "two\nlines")], "name string, v double, t string").coalesce(1)
    reports.write_csv(df.where("v IS NOT NULL"), f"{tmp_path}/csv")
    assert [tuple(r) for r in jsonl.read_csv(spark, f"{tmp_path}/csv", "name string, v double, t string").collect()] == [("a,b", 1.5, 'say "x"')]
    reports.write_table(df, f"{tmp_path}/t", "100% of it")
    md = (tmp_path / "t.md").read_text().splitlines()
    assert md[0] == "| name   | v   | t         |" and md[3] == "| c\\|d_e | -   | two lines |"
    assert r"c|d\_e & -- &" in (tmp_path / "t.tex").read_text() and r"\caption{100\% of it}" in (tmp_path / "t.tex").read_text()
    assert (tmp_path / "t.csv").read_text().startswith('name,v,t\n"a,b",1.5,"say ""x"""')
    with pytest.raises(ValueError):
        reports.small_table(spark.range(11), 10)
    jsonl.write_jsonl(df, f"{tmp_path}/j")
    jsonl.write_jsonl(df, f"{tmp_path}/j", append=True)
    assert jsonl.read_jsonl(spark, f"{tmp_path}/j", "name string, v double").count() == 4
    jsonl.write_jsonl(df.limit(1), f"{tmp_path}/j")
    assert jsonl.read_jsonl(spark, f"{tmp_path}/j", "name string, v double").count() == 1


def test_archive(spark, tmp_path):
    for n in ("x/a.jsonl", "x/b.jsonl", "y/c.jsonl"):
        (tmp_path / n).parent.mkdir(exist_ok=True)
        (tmp_path / n).write_text(n * 10)
    patterns = [f"{tmp_path}/y/*.jsonl", f"{tmp_path}/*/*.jsonl", f"{tmp_path}/none/*.jsonl"]
    assert [r.path.rsplit("/", 2)[1] for r in reports.file_list(spark, patterns).collect()] == ["y", "x", "x"]
    got = reports.archive(spark, patterns, f"{tmp_path}/out", 2).collect()
    held = {}
    for p in sorted((tmp_path / "out").glob("*.tar")):
        with tarfile.open(p) as t:
            held |= {m.name: t.extractfile(m).read().decode() for m in t.getmembers()}
    assert len(got) == 3 and held == {f"{tmp_path}/{n}".lstrip("/"): n * 10 for n in ("x/a.jsonl", "x/b.jsonl", "y/c.jsonl")}
    assert reports.archive(spark, patterns[2:], f"{tmp_path}/out2").count() == 0
