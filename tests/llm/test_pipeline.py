"""Each stage of the pipeline against brute force on its own input."""

import collections

import pytest

import corpus_pipeline
from notelake.llm.near_dedup import near_duplicates
from tests.llm.test_operators import LOWER, _near

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, function) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        function(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])


def test_quality_keeps_clean_documents(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in stages[1].select("doc_id").collect()}
    known = labels.collect()
    assert all(r.doc_id in kept for r in known if r.quality == 1)
    assert sum(r.doc_id in kept for r in known if r.quality == 0) <= 0.1 * sum(r.quality == 0 for r in known)


def test_exact(stages):
    best = {}
    for r in stages[1].collect():
        key = (r.text or "").translate(LOWER)
        best[key] = max(best.get(key, r), r, key=lambda x: x.doc_id)
    assert sorted(stages[2].collect()) == sorted(best.values())


def test_near(stages):
    rows = stages[2].collect()
    stay = {i for i, (_, _, kept) in _near([(r.doc_id, r.text) for r in rows], 5).items() if kept}
    assert sorted(stages[3].collect()) == sorted(r for r in rows if r.doc_id in stay)


def test_mixture_repeats_whole_documents(stages):
    before, after = {r.doc_id: r for r in stages[3].collect()}, stages[4].collect()
    times = collections.Counter(r.doc_id for r in after)
    assert all(r == before[r.doc_id] for r in after) and max(times.values()) <= 3
    words = sum(len((r.text or "").split()) for r in before.values())
    assert abs(sum(len((r.text or "").split()) for r in after) - corpus_pipeline.MIXTURE * words) < 0.25 * words  # a leaf takes the document that its budget ends in


def test_packing(stages):
    got = stages[5].toPandas()
    assert (got.piece == 0).sum() == stages[4].count()
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() <= 2048 and len(fill) <= -(-got.length.sum() // 2048) * 1.02 + 1


def test_a_table_without_documents(spark, stages):
    docs = stages[0].limit(0)
    for _, function in corpus_pipeline.STAGES:
        docs = function(spark, docs, SF)
    assert docs.count() == 0
    assert near_duplicates(stages[0].limit(0)).count() == 0


def test_any_column_comes_through(spark, stages):
    """Nulls in every column, repeated ids, and columns named like those of the stages."""
    names = ["score", "__score", "times", "total", "tokens", "row", "carried_3", "kept", "bucket", "epoch", "Text"]
    few = [r for r in stages[0].collect()][:40]
    rows = [(r.doc_id, r.text, r.lang, r.source, *[f"{n}{r.doc_id}" for n in names]) for r in few] + [(None, None, None, None, *[None] * len(names)), (few[0].doc_id, few[1].text, None, None, *names), (few[0].doc_id, few[0].text, "en", "src1", *names), (None, "", "en", None, *names)]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    have = collections.Counter(map(tuple, rows))
    for _, function in corpus_pipeline.STAGES[:-1]:
        out = [tuple(r) for r in function(spark, docs, SF).collect()]
        assert set(out) <= set(have) and out, function.__name__
    assert function(spark, docs, SF).columns == docs.columns
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert sum(r.piece == 0 for r in pieces) == len(rows)
    exact = [tuple(r) for r in corpus_pipeline.exact(spark, docs, SF).collect()]
    assert collections.Counter((r[1] or "").translate(LOWER) for r in exact) == {(r[1] or "").translate(LOWER): 1 for r in rows}
