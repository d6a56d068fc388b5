"""The command line, end to end on small files."""

import pytest

from tessera.__main__ import main


@pytest.fixture
def text(tmp_path):
    (tmp_path / "text").write_text("a perfect day\na perfect day again\nthe day\n\n")
    return f"{tmp_path}/text"


def test_counts(spark, text, tmp_path):
    got = main(["word-count", "--input", text, "--output", f"{tmp_path}/out"], spark)
    assert sorted(r.value for r in got.collect()) == ["a\t2", "again\t1", "day\t3", "perfect\t2", "the\t1"]
    assert [tuple(r) for r in main(["followers", "--input", text], spark).collect()] == [("day", 2)]
    pairs = main(["pmi-pairs", "--input", text, "--threshold", "2"], spark).collect()
    assert [(r.x, r.y) for r in pairs] == [("a", "day"), ("a", "perfect"), ("day", "a"), ("day", "perfect"), ("perfect", "a"), ("perfect", "day")]


def test_retrieval(spark, text, tmp_path):
    main(["index", "--input", text, "--output", f"{tmp_path}/index"], spark)
    got = main(["query", "--index", f"{tmp_path}/index", "--collection", text, "--query", "perfect again AND the OR"], spark)
    assert [(r.doc, r.snippet) for r in got.collect()] == [(1, "a perfect day again"), (2, "the day")]


def test_ranks(spark, tmp_path):
    (tmp_path / "graph").write_text("0 1 2\n1 2\n2\n3 0\n")
    top = main(["top-nodes", "--input", f"{tmp_path}/graph", "--sources", "0,1", "--top", "2", "--iterations", "3"], spark).collect()
    assert len(top) == 2 and all(len(r.p.partition(".")[2]) == 5 for r in top)
    order = main(["rank-order", "--input", f"{tmp_path}/graph", "--iterations", "50", "--tolerance", "1e-4"], spark).collect()
    assert [r.id for r in order][0] == 2 and order[0].log_p < 0


def test_models(spark, tmp_path):
    (tmp_path / "docs").write_text("d1 spam 1 2\nd2 ham 1\n")
    main(["train", "--input", f"{tmp_path}/docs", "--model", f"{tmp_path}/model"], spark)
    got = main(["apply", "--input", f"{tmp_path}/docs", "--model", f"{tmp_path}/model"], spark).collect()
    assert {r.docid: r.predicted for r in got} == {"d1": "spam", "d2": "spam" if got[0].score > 0.002 else "ham"}


def test_tables(spark):
    assert main(["q1", "--input", "/root/testdata/sf0.001", "--parquet"], spark).first().n_items == main(["run", "q1_shipped_count", "--input", "/root/testdata/sf0.001"], spark).first().n_items
    assert main(["q7", "--input", "/root/testdata/sf0.001", "--date", "1998-06-15"], spark).count() == 5
