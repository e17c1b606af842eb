"""Line dedup of texts with very many lines."""

from tessera.llm import lines


def test_text_of_200000_lines(spark):
    n = 200_000
    once = [f"line {i} of the very long text" for i in range(n)]
    long = "\n".join([*once, *once[100:40_000], "", *once[7:9]])
    df = spark.createDataFrame([(1, long, n), (2, "\n".join(once[50:53]) + "\nown", 4), (3, None, 0), (None, long, n)], "doc_id long, text string, n_chars long").repartition(3)
    got = {r.doc_id: r for r in lines.deduplicated(df).collect()}
    assert got[1].kept_text == "\n".join([*once, "", *once[7:9]]) and got[1].n_removed == 39_900
    assert (got[2].kept_text, got[2].n_removed) == ("own", 3) and got[3].kept_text is None and got[None].kept_text == long
    assert {r.doc_id: r.n_chars for r in lines.dedup_documents(df).collect()}[1] == len(got[1].kept_text)
