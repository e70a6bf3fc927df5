"""The pipeline's stages: what each decides takes effect, and clean documents stay."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before[name] = docs.count()
        if name != "packing":
            assert out.columns == columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "simhash":
            assert out.count() == out.select("doc_id").distinct().count() < before[name]
            assert out.select("text").distinct().count() == docs.select("text").distinct().join(out.select("text").distinct(), "text").count()
        if name == "secrets":
            from kinfold.llm import secrets

            assert out.count() == before[name] and secrets.scan(out).where("exists(spans, s -> s.kind < 3)").count() == 0
        docs = out
    assert docs.select("sequence_id").distinct().count() > 0
    assert before["simhash"] > 0.8 * before["toxicity"]


CLASHES = ("size", "copies", "target", "taken", "_key", "_s", "_copy", "_score", "_r", "_row", "row", "key", "rank", "copy", "_base", "_tokens", "_spans", "source_size", "id", "length")


@pytest.fixture(scope="module")
def odd(spark):
    text = "some plain words of a text that is long enough to have shingles and a number 42"
    rows = [
        (1, text, "en", "a", 5), (1, text, "en", "a", 5), (1, "another text of the same number " * 3, "en", "a", 6), (2, None, None, None, None), (3, "", "en", None, 0), (4, " \n ", "en", "b", 3),
        (None, text + " indeed", "en", "b", 7), (None, text + " indeed", "en", "b", 7), (None, "no number and a text of its own that nothing else is like", "en", "c", 8),
        (2**63 - 1, "password = hunter2hunter2 " + "word " * 60_000, "de", "c", 9), (8, "a-" * 3000 + "1", "en", "c", 9), (9, "x <|endoftext|> y", "en", "c", 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(f"<{c}>") for c in CLASHES}).persist()


@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows_and_any_columns(spark, odd, name, stage):
    out = stage(spark, odd, DATA)
    rows = [r.asDict() for r in out.collect()]
    if name != "packing":
        assert out.columns == odd.columns and out.dtypes == odd.dtypes
        assert all(r[c] == f"<{c}>" for r in rows for c in CLASHES)
    assert len(stage(spark, odd.limit(0), DATA).collect()) == 0
    texts = {(r["doc_id"], r["text"]) for r in odd.collect()}
    if name == "toxicity":
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts and len(rows) >= 10
    elif name == "simhash":
        # The first of three near copies, all texts of their own, and one of those without words.
        assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in rows) == sorted([(1, 79), (1, 96), (2, 0), (0, 57), (8, 6001), (9, 17), (2**63 - 1, 300_026)])
    elif name == "secrets":
        by_id = {(r["doc_id"], r["n_chars"]): r["text"] for r in rows}
        assert len(rows) == 12 and by_id[2, None] is None and by_id[2**63 - 1, 300_009] == "[secret] " + "word " * 60_000
        assert {t for i, t in texts if i != 2**63 - 1} == {r["text"] for r in rows if r["doc_id"] != 2**63 - 1}
    elif name == "mixing":
        assert {(r["doc_id"], r["text"]) for r in rows} <= texts
    else:
        assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows) and sum(r["length"] for r in rows if r["doc_id"] == 9) == 5
        assert all(len(r["ids"]) == r["length"] for r in rows) and sum(1 for r in rows if r["doc_id"] == 1 and r["piece"] == 0) == 3


def test_run_leaves_its_result_alone(spark):
    from pathlib import Path

    from kinfold.llm.store import shared_folder

    out = corpus_pipeline.run(spark, DATA)
    folder = Path(shared_folder(spark).removeprefix("file:"))
    left = [p for p in folder.glob("pipeline-*/*") if p.parent.name in out.inputFiles()[0]]
    assert [p.name for p in left] == ["packing"] and not list(folder.glob("scratch-*"))
    assert out.count() > 0 and "ids" in out.columns
