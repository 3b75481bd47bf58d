"""The five stages: contracts, decisions that take effect, and the same result on a rerun."""

import collections

import pytest

import corpus_pipeline as C
from funnelspark.llm import quality_rules as Q
from plain import words


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """{name: (input, output)} of every stage over the documents of the smallest data."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {}
    for name, stage in C.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out[name] = (docs, after)
        docs = after
    return out


def test_names_and_columns(spark, sf_dir, stages):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "line_dedup", "jaccard_join", "mixing", "best_fit_packing"]
    columns = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "best_fit_packing")


def test_quality_stage_removes_what_it_rejects(spark, sf_dir, stages):
    before, after = stages["quality_rules"]
    verdict = {r["doc_id"]: r["kept"] for r in Q.op7_quality_rules(spark, sf_dir).collect()}
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if verdict[r["doc_id"]]}


def test_line_stage_rewrites_texts(stages):
    before, after = stages["line_dedup"]
    old, new = ({r["doc_id"]: r for r in df.collect()} for df in (before, after))
    assert old.keys() == new.keys()
    assert all(new[k]["n_chars"] == len(new[k]["text"]) for k in new)
    assert all(collections.Counter(new[k]["text"].split("\n")) <= collections.Counter(old[k]["text"].split("\n") + [""]) for k in new)


def test_jaccard_stage_keeps_one_of_each_class(stages):
    from test_jaccard import brute
    before, after = stages["jaccard_join"]
    classes = brute([(r["doc_id"], r["text"]) for r in before.collect()])
    expected = {c if n else k for k, n, c in classes}
    assert sorted(r["doc_id"] for r in after.collect()) == sorted(expected)


def test_mix_and_pack_stages(stages):
    before, after = stages["mixing"]
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    copies = collections.Counter(r["doc_id"] for r in after.collect())
    assert copies.keys() <= texts.keys() and max(copies.values()) <= 3
    packed = collections.Counter()
    for r in stages["best_fit_packing"][1].collect():
        packed[r["doc_id"]] += r["n_words"]
    assert packed == collections.Counter({k: n * len(words(texts[k])) for k, n in copies.items()})


def test_run_gives_the_rows_of_the_stages(spark, sf_dir, stages):
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(C.run(spark, sf_dir)) == key(stages["best_fit_packing"][1])


def test_line_stage_keeps_other_rows_as_they_are(spark, make_docs):
    line = "a line that is long enough to be counted, in many documents"
    df = make_docs([(i, f"{line}\nown {i}") for i in range(6)] + [(10, None), (11, "")])
    out = {r["doc_id"]: r for r in C.line_dedup(spark, df, "").collect()}
    assert C.line_dedup(spark, df, "").columns == df.columns
    assert out[0]["text"] == "own 0" and out[0]["n_chars"] == 5 and out[5]["text"] == f"{line}\nown 5" and out[10]["text"] is None and out[11]["text"] == ""


def test_empty_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
