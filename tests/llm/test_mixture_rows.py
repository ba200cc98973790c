"""The mixture of the pipeline on rows whose ids are null or repeated: each row is counted by itself."""

import collections

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _taken(spark, rows) -> collections.Counter:
    return collections.Counter(r.text for r in corpus_pipeline.mixture(spark, spark.createDataFrame(rows, SCHEMA), "").collect())


def test_each_row_of_an_id_has_its_own_epochs(spark):
    ids = [None] * 4 + [7] * 5 + [8, 9, 10]
    got = _taken(spark, [(i, f"row {n} of ten words a b c d e f", "en", "src3", 1) for n, i in enumerate(ids)])
    assert len(got) == len(ids) and set(got.values()) <= {1, 2} and sum(got.values()) == 1.5 * len(ids)


def test_rows_not_taken_stay_out(spark):
    rows = [(n, f"en {n}", "en", "src3", 1) for n in range(100)] + [(None if n % 2 else 5, f"fr {n}", "fr", "src3", 1) for n in range(100)]
    got = _taken(spark, rows)
    french = {t: n for t, n in got.items() if t.startswith("fr")}
    assert sum(got.values()) in (300, 301) and max(got.values()) <= 3
    assert len(french) in (43, 44) and set(french.values()) == {1}  # a seventh of the budget: under an epoch
