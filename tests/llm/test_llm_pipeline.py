"""The pipeline stage by stage, each against a brute-force version on the stage's own input."""

import pytest
from test_llm_operators import BYTE_TOKENIZER, brute_components, brute_contamination, brute_fingerprint, check_packing, cut_pieces, whole_ids

import corpus_pipeline
from quillspark.llm import quality


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        given = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, sf).write.parquet(path)
        before, docs = docs, spark.read.parquet(path)
        if k + 1 < len(corpus_pipeline.STAGES):
            assert docs.columns == columns
        out.append((name, given, before, docs))
    return out


def kept(stages, k):
    _, given, before, docs = stages[k]
    return given, {r["doc_id"]: r["text"] for r in docs.collect()}, before


def test_names(stages):
    assert [s[0] for s in stages] == ["quality classifier", "exact dedup", "SimHash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_quality(spark, sf, stages):
    given, left, before = kept(stages, 0)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.train(before, labels)
    assert set(left) == {d for d, t in given.items() if model.score(quality.statistics(t))[0] >= 0.7}
    marked = {r["doc_id"]: r["quality"] for r in labels.collect()}
    good = [d for d, q in marked.items() if q == 1]
    assert sum(d in left for d in good) >= 0.97 * len(good)


def test_exact(stages):
    given, left, _ = kept(stages, 1)
    assert left == {d: t for t, d in {t: d for d, t in sorted(given.items())}.items()}


def test_near(stages):
    given, left, _ = kept(stages, 2)
    fp = {d: brute_fingerprint(t) for d, t in given.items()}
    root, least = brute_components(set(fp.values()), 4), {}
    for d in sorted(fp):
        least.setdefault(root[fp[d]], d)
    assert set(left) == set(least.values())


def test_decontamination(spark, sf, stages):
    given, left, _ = kept(stages, 3)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(left) == {row[0] for row in brute_contamination(given.items(), items) if not row[-1]}


def test_packing(stages):
    _, given, _, docs = stages[4]
    ids = whole_ids(BYTE_TOKENIZER, given.values(), 0)
    n = check_packing(docs.collect(), {d: cut_pieces(x) for d, x in zip(given, ids, strict=True)})
    assert n <= 1.02 * sum(map(len, ids)) / 2048 + 1


def test_whole_run(spark, sf, stages):
    assert corpus_pipeline.run(spark, sf).count() == stages[-1][3].count()


def test_odd_tables(spark, sf):
    schema = spark.read.parquet(f"{sf}/documents.parquet").schema
    odd = spark.createDataFrame([(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0), (None, "x", None, None, None), (3, "word " * 5000, "en", "s", 1)], schema)
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            docs.collect()


def test_empty_labels_and_one_id(spark, sf, tmp_path):
    """Without labels nothing is rejected; a text that shares its doc_id with a copy stays."""
    import shutil

    for name in ("documents", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert corpus_pipeline.good(spark, docs, str(tmp_path)).count() == docs.count()
    rows = spark.createDataFrame([(5, "A", "en", "s", 1), (5, "B", "en", "s", 1), (9, "A", "en", "s", 1), (2, "C", None, None, 1)], docs.schema)
    for stage in (corpus_pipeline.exact, corpus_pipeline.near):
        assert {r["text"] for r in stage(spark, rows, sf).collect()} == {"A", "B", "C"}
