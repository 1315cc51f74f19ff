"""The pipeline's stages one by one, each judged on its own input."""

import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"input": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out[name] = docs
    return out


def test_order_and_columns(stages):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]
    for name in names[:-1]:
        assert stages[name].columns == stages["input"].columns
    assert {"sequence_id", "offset", "piece"} <= set(stages[names[-1]].columns)


def test_each_stage_decides(stages, spark):
    from tidecast.llm import decontaminate, jaccard_join, substring_dedup

    ids = {n: {r.doc_id for r in d.select("doc_id").distinct().collect()} for n, d in stages.items()}
    assert ids["toxicity"] < ids["input"]
    groups = jaccard_join.jaccard_components(stages["toxicity"]).collect()
    assert ids["ngram_jaccard_join"] == {r.component_id for r in groups}
    assert ids["substring_dedup"] == ids["ngram_jaccard_join"]
    again = substring_dedup.remove_repeats(stages["ngram_jaccard_join"]).collect()
    lengths = {r.doc_id: r.n_chars for r in stages["substring_dedup"].collect()}
    before = {r.doc_id: r.n_chars for r in stages["ngram_jaccard_join"].collect()}
    assert all((lengths[r.doc_id] != before[r.doc_id]) >= (r.n_removed > 0) for r in again)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    marked = decontaminate.contamination(stages["substring_dedup"], bench).where("contaminated").collect()
    assert ids["benchmark_decontamination"] == ids["substring_dedup"] - {r.doc_id for r in marked}
    assert ids["best_fit_packing"] == ids["benchmark_decontamination"]


def test_run_gives_the_last_stage(spark, stages):
    want = sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages["best_fit_packing"].collect())
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, SF).collect()) == want


ODD = [None, "", " \t", "one", "One", "two words", "a " * 500, "é ü", "x" * 5000, None, "a b", "the same few words here again"] * 2


@pytest.mark.parametrize("rows", [len(ODD), 0])
def test_stages_take_odd_rows_and_clashing_columns(spark, tmp_path, rows):
    found = [(k, t, None if k % 3 else "en", "s", len(t or ""), 1, 2, "k", 3, 4.0) for k, t in enumerate(ODD[:rows])]
    docs = spark.createDataFrame(found, "doc_id long, text string, lang string, source string, n_chars long, n int, at int, key string, component_id long, score double")
    labels = [(k, None, int(k % 12 == 5)) for k in range(24)] + [(3, 1, None), (900, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{tmp_path}").write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "best_fit_packing":
            assert after.columns == docs.columns
            docs = after
    assert bool(docs.count()) == bool(rows)
    assert after.select("doc_id").distinct().count() == docs.count()


def test_repeated_rows_are_one_document(spark, tmp_path):
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", 5), (1, text, "en", 5), (2, text, "en", 5), (3, "short", "en", 5), (3, "another text", "en", 6), (4, None, "en", 0), (None, "no id", "en", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    spark.createDataFrame([(3, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, docs, f"{tmp_path}").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        ids = sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect())
        assert ids == [(False, k) for k in ([1, 1, 2, 3, 3, 4] if name == "toxicity" else [1, 3, 4])] + [(True, 0)], name
