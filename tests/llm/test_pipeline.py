"""Each stage against what its operator's own brute-force version keeps."""

import random

import corpus_pipeline as pipeline
from tests.llm import test_bpe, test_decontaminate, test_linededup, test_neardup
from tests.llm.conftest import DOCUMENTS


def test_stages(spark, sf, documents):
    docs, columns = documents, documents.columns
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "bpe"]
    for name, stage in pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        out = stage(spark, docs, sf).cache()
        if name == "bpe":
            test_bpe.check(out.drop("ids").collect(), list(before.items()))
            assert all(r.ids == test_bpe.library(before[r.doc_id]) for r in out.collect())
            break
        assert out.columns == columns
        after = {r.doc_id: r.text for r in out.collect()}
        assert out.count() == len(after)
        if name == "toxicity":
            from reliefspark.llm import toxicity

            scored = toxicity.with_scores(docs, toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))).collect()
            assert after == {r.doc_id: r.text for r in scored if r.score < 0.5}
        if name == "line dedup":
            want = {i: t for i, _, n, _, t in test_linededup.whole(list(before.items())) if not n or test_linededup.WORD.search(t)}
            assert after == want and all(r.n_chars == len(r.text) for r in out.collect() if r.text != before[r.doc_id])
        if name == "near dedup":
            assert after == {i: before[i] for i, _, _, kept in test_neardup.brute(list(before.items()), 5) if kept}
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            bad = {r[0] for r in test_decontaminate.brute(list(before.items()), items)}
            assert bad and after == {i: t for i, t in before.items() if i not in bad}
        docs = out


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 50


def test_tricky(spark, tricky, no_documents, sf):
    for docs in (tricky, no_documents):
        columns = docs.columns
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf)
            assert name == "bpe" or docs.columns == columns
        docs.count()
    assert DOCUMENTS.startswith("doc_id")


def test_exact_copies_of_short_lines(spark, sf):
    """Line dedup takes an exact copy whole, so that no scrap of it passes near dedup as a document of its own."""
    rng = random.Random(4)
    texts = ["\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(6)) for _ in range(25)) for _ in range(30)]
    docs = spark.createDataFrame([(100 * k + i, t, "en", "s", len(t), "", "", "", "") for k in range(2) for i, t in enumerate(texts)], DOCUMENTS)
    docs = pipeline.line_dedup_stage(spark, docs, sf)
    assert {r.doc_id: r.text for r in docs.collect()} == dict(enumerate(texts))
    assert {r.doc_id for r in pipeline.near_dedup_stage(spark, docs, sf).collect()} == set(range(30))
