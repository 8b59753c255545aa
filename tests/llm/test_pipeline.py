"""The pipeline's stages on the smallest tables, each judged on its own input."""

from collections import Counter

import corpus_pipeline
import pytest
from screenpulse.llm import quality
from test_text_operators import brute_components, brute_contamination, brute_print, brute_runs, rows


def test_stages(spark, small, folder):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "decontamination", "packing"]
    docs = small
    texts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == small.columns and out.dtypes == small.dtypes, name
        before, after = rows(docs), rows(out)
        ids = {r["doc_id"] for r in after}
        assert len(ids) == len(after) and ids <= {r["doc_id"] for r in before}
        if name == "quality":
            labels = spark.read.parquet(f"{folder}/labels.parquet")
            assert ids == {r["doc_id"] for r in rows(quality.score_quality(docs, labels)) if r["keep"]}
        if name == "line_dedup":
            assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
            assert sum(len(r["text"]) for r in after) < sum(len(r["text"]) for r in before)
        if name == "near_dedup":
            assert ids == set(brute_components([(r["doc_id"], brute_print(r["text"])) for r in before]).values())
        if name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{folder}/benchmark.parquet"))]
            assert ids == {r["doc_id"] for r in before if not brute_contamination(r["text"], items)[1]}
        texts = {r["doc_id"]: r["text"] for r in after}
        docs = spark.createDataFrame(after, small.schema)
    pieces = rows(corpus_pipeline.STAGES[-1][1](spark, docs, folder))
    assert {p["doc_id"] for p in pieces} == set(texts)
    whole = rows(corpus_pipeline.run(spark, folder))
    assert sum(p["length"] for p in whole) == sum(p["length"] for p in pieces)


@pytest.fixture
def no_sides(spark, tmp_path, folder):
    """A folder whose side tables are empty."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def brute_kept_lines(docs):
    """{(doc_id, text): text without later copies of 50-word runs}."""
    order = sorted({(d is not None, d or 0, t or "") for d, t in docs})
    gone = brute_runs([t for _, _, t in order], 50)
    return {(d if has else None, t): "\n".join(x for i, x in enumerate(t.split("\n")) if i not in g) for (has, d, t), g in zip(order, gone, strict=True)}


@pytest.mark.parametrize("sides", ["full", "empty"])
def test_stages_on_odd_rows(spark, odd, folder, no_sides, sides):
    """Nulls anywhere, empty, blank and very long texts, ties, repeats, clashing columns; with and without side tables."""
    at, docs = folder if sides == "full" else no_sides, odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == odd.columns and out.dtypes == odd.dtypes, name
        before, after = rows(docs), rows(out)
        keys = lambda some: Counter((r["doc_id"], r["lang"], r["source"]) for r in some)
        assert keys(after) <= keys(before)
        if name == "quality" and sides == "empty":
            assert len(after) == len(before)  # nothing to learn from, nothing to reject
        if name == "line_dedup":
            assert keys(after) == keys(before)
            short = [(r["doc_id"], r["text"]) for r in before if len(r["text"] or "") < 10_000]
            want = brute_kept_lines(short)
            changed = {(r["doc_id"], r["text"]) for r in after}
            assert all((d, want[d, t or ""]) in changed or (not t and (d, t) in changed) for d, t in short)
        if name == "decontamination" and sides == "empty":
            assert len(after) == len(before)
        docs = out
    pieces = rows(corpus_pipeline.STAGES[-1][1](spark, docs, at))
    assert Counter(p["doc_id"] for p in pieces).keys() == Counter(r["doc_id"] for r in rows(docs)).keys()


def test_a_run_leaves_little_behind(spark, folder):
    import os

    from screenpulse.llm.common import forget_all, shared_dir

    forget_all(spark)
    before = set(os.listdir(shared_dir(spark)))
    out = corpus_pipeline.run(spark, folder)
    left = sorted(n.split("-")[1] for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("screenpulse"))
    assert left == ["decontamination", "ids"] or (left[0] == "decontamination" and len(left) <= 3)
    assert out.count() > 0
    forget_all(spark)
    assert not [n for n in set(os.listdir(shared_dir(spark))) - before if n.startswith("screenpulse")]


def test_empty_tables(spark, none, folder):
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0

