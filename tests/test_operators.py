import pytest
from pyspark.sql import functions as F

from tessella.functions import text as T
from tessella.operators import corpus, logs, packing
from tessella.sources import readers


def test_sequential_rows():
    docs = [[10, 11], [20, 21, 22]]
    assert packing.sequential_rows(docs, 7, 2, 1) == [[10, 11, 2, 20, 21, 22, 2, 10]]
    assert packing.sequential_rows(docs[1:], 4, 2, 1) == [[20, 21, 22, 2, 20]]
    with pytest.raises(ValueError):
        packing.sequential_rows([], 4, 2, 1)


def test_learning_rate(spark):
    edges = logs.cycle_edges(55200, 244141, 3)
    assert edges == [55200, 118181, 181161, 244141]
    steps = spark.createDataFrame([(s,) for s in (55200, 56199, 118180, 118181, 244141)], "s long")
    got = [r[0] for r in steps.select(logs.learning_rate(F.col("s"), edges, 1000, 3.60865e-5, 1e-4, 1e-5)).collect()]
    assert got == pytest.approx([3.60865e-5, 1e-4, 1e-5, 1e-4, 1e-5])


LINE = "2026-01-01 00:00:{:02d},000 INFO train: step={} loss=1.5 ppl=4.5 lr=1.0e-04 grad_norm=0.5 tokens=10 tok/s=5.0"


def test_log_rollback(spark):
    rows = [("r", 1, LINE.format(1, 100)), ("r", 2, LINE.format(2, 101)), ("r", 3, "2026-01-01 00:00:03,000 INFO train: validation step=101 loss=1.4 ppl=4.1 per_category=1=3.5,2=4.0"),
            ("r", 4, "2026-01-01 00:00:04,500 INFO train: resumed=runs/a/step_100 step=100 tokens=10 final_step=200"), ("r", 5, "noise"), ("s", 1, "2026-01-01 00:00:05,000 INFO train: resumed from x at step=7 tokens=3")]
    points = logs.parse(spark.createDataFrame(rows, "run string, line_no int, value string"))
    got = {(r.run, r.line_no): (r.kind, r.step, r.loss, r.per_category) for r in points.collect()}
    assert got == {("r", 1): ("point", 100, 1.5, None), ("r", 2): ("point", 101, 1.5, None), ("r", 3): ("validation", 101, 1.4, {"1": 3.5, "2": 4.0}), ("r", 4): ("resume", 100, None, None), ("s", 1): ("resume", 7, None, None)}
    assert [(r.kind, r.step) for r in logs.rollback(points, ["run"], "line_no", "step", F.col("kind") == "resume").collect()] == [("point", 100)]


def test_downsample_keeps_ends_and_spike(spark):
    pts = spark.range(2000).select(F.lit(1).alias("k"), F.col("id").alias("x"), F.when(F.col("id") == 573, 999.0).otherwise(0.0).alias("y"))
    got = {r.x for r in logs.minmax_downsample(pts, ["k"], "x", "y", 49).collect()}
    assert len(got) <= 100 and {0, 573, 1999} <= got


def test_paragraph_owners(spark):
    docs = spark.createDataFrame([(1, "a", "x\n\nx\ny"), (2, "b", "y\nz"), (3, "b", "x")], "doc_id long, source string, text string")
    got = {r.doc_id: r.final for r in corpus.rebuild(corpus.dedup_paragraphs(docs), docs).collect()}
    assert got == {1: "x\nx\ny", 2: "z", 3: ""}


def test_cleaning_and_reasons(spark):
    docs = spark.createDataFrame([(1, "﻿a\r\nb 　\n\n\n\nc�"), (2, "word " * 9 + "words"), (3, "see http://x " + "word " * 20), (4, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in corpus.quality_cascade(corpus.clean(docs)).collect()}
    assert rows[1].text == "a\nb\n\nc" and rows[1].reason == "too_short"
    assert rows[2].reason is None and rows[3].reason == "url" and rows[4].reason == "too_short"


def test_line_chunks_and_lookup(spark):
    lines = spark.createDataFrame([("f", i, "" if i % 2 else str(i)) for i in range(10)], "file string, line_no int, value string")
    assert [(r.chunk, r.text) for r in readers.line_chunks(lines, 3).orderBy("chunk").collect()] == [(1, "0\n2\n4"), (2, "6\n8")]
    ends = spark.createDataFrame([(1, 0, 10), (2, 10, 35)], "doc_id int, low int, high int")
    draws = spark.createDataFrame([(9,), (10,), (34,)], "position int")
    assert sorted((r.position, r.doc_id) for r in packing.position_lookup(ends, draws, 8).collect()) == [(9, 1), (10, 2), (34, 2)]


def test_distinct_four_grams_of_all_documents(spark):
    from tessella.plans import catalog

    texts = [None, "", "abcd", "abcde", "ab\n" * 20, "ab cd ef " * 2000, "héé😀" * 7, " ".join(f"w{i * i % 997}" for i in range(5000))]
    docs = spark.createDataFrame([(i, t, None if i == 3 else len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, n_chars int")
    got = {r.doc_id: r.ratio for r in catalog._four_grams(docs).collect()}
    for i, t in enumerate(texts):
        g = [t[k:k + 4] for k in range(len(t) - 3)] if t else []
        assert got.pop(i) == (None if not t or len(t) < 5 else pytest.approx(len(set(g)) / len(g), abs=5.1e-4))
    assert not got


def test_entry_without_llm():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
