"""Every stage of the pipeline on empty tables, nulls, repeated rows, long texts and columns whose names clash."""

import pytest

import corpus_pipeline

SMALL = "/root/testdata/sf0.001"
BASE = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("score", "predicted", "held_out", "node", "component_id", "kept", "item_id", "spans", "ids", "n_tokens", "label", "y")
STAGES = dict(corpus_pipeline.STAGES)
FILTERS = [name for name, _ in corpus_pipeline.STAGES[:-1]]


def documents(spark, rows):
    schema = ", ".join([BASE, *(f"{c} string" for c in CLASHING)])
    return spark.createDataFrame([(*r, *(["kept as is"] * len(CLASHING))) for r in rows], schema)


ROWS = [
    (1, "A calm walk along the river in the morning light.", "en", "a", 49),
    (1, "A calm walk along the river in the morning light.", "en", "a", 49),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (None, "Another quiet evening with some tea and an old book.", "en", None, 52),
    (4, "word " * 100_000, "en", "a", 500_000),
]


@pytest.mark.parametrize("name", STAGES)
def test_empty(spark, name):
    docs = documents(spark, [])
    out = STAGES[name](spark, docs, SMALL)
    assert out.count() == 0 and (name not in FILTERS or out.columns == docs.columns)


@pytest.mark.parametrize("name", STAGES)
def test_odd_rows(spark, name):
    docs = documents(spark, ROWS)
    out = STAGES[name](spark, docs, SMALL)
    rows = out.collect()
    want = len(ROWS) - (name == "near duplicates")  # of the repeated row one stays
    assert len(rows) == want
    if name in FILTERS:
        assert out.columns == docs.columns
        assert all(r[c] == "kept as is" for r in rows for c in CLASHING)
        assert {(r.doc_id, r.text) for r in rows} == {r[:2] for r in ROWS}


def test_batches_stay_modest(spark):
    from touchline.llm.common import TEXT_BYTES, modest

    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    old = spark.conf.get(rows), spark.conf.get(size)
    try:
        for given, want in ((("10000", "256MB"), ("2000", str(TEXT_BYTES))), (("500", "4mb"), ("500", "4mb")), (("0", "1g"), ("2000", str(TEXT_BYTES)))):
            spark.conf.set(rows, given[0]), spark.conf.set(size, given[1])
            modest(spark)
            assert (spark.conf.get(rows), spark.conf.get(size)) == want
    finally:
        spark.conf.set(rows, old[0]), spark.conf.set(size, old[1])
