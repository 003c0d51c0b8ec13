"""Documents as arrays give what tokens as rows gave."""

import random

import pytest
from pyspark.sql import functions as F

from vocarium import queries
from vocarium.functions import text
from vocarium.operators import counts, heldout, lists, vocab
from vocarium.plans import laboratory


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    rows = [(k * 70_000, " ".join(rng.choice("abcdefghij") for _ in range(n))) for k, n in enumerate([40, 1, 0, 2, 9, 3, 300, 1, 1, 5, 8, 60])]
    rng.shuffle(rows)
    return spark.createDataFrame([*rows, (5, None)], "doc_id long, text string")


def same(a, b):
    return sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(a.columns).collect()))


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("per_document", [False, True])
@pytest.mark.parametrize("harmonic", [False, True])
def test_counts_from_arrays_equal_counts_from_rows(spark, docs, monkeypatch, small, per_document, harmonic):
    if small:
        monkeypatch.setattr(lists, "TABLE_WORDS", 0)
    monkeypatch.setattr(lists, "RUN", 7)
    monkeypatch.setattr(counts, "BLOCK", 32)
    t, arrays = text.tokens(docs), text.token_lists(docs)
    v = lists.build_vocab(arrays, 8, 5)
    assert same(v, vocab.build_vocab(t, 8, 5))
    rows, ids = vocab.encode(t, v), lists.encode(arrays, v)
    assert same(lists.positions(ids), rows)
    assert same(lists.cooccurrence(ids, 8, 4, harmonic, 2.0, per_document), counts.cooccurrence(rows, 4, harmonic, 2.0, per_document))


def test_no_token_is_a_row_in_the_sum_over_documents(docs):
    ids = lists.encode(text.token_lists(docs), lists.build_vocab(text.token_lists(docs), 8, 5))
    plan = lists.cooccurrence(ids, 8, 4, True, 0.0, True)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_halves_by_arithmetic(docs, monkeypatch, spark):
    monkeypatch.setattr(queries, "_table", lambda *a: docs)
    t = text.tokens(docs)
    for block in (3, 4000):
        want = {r["half"]: r["n"] for r in t.join(vocab.doc_offsets(t), "doc_ord").groupBy(heldout.half(F.col("before") + F.col("pos"), block).alias("half")).agg(F.count(F.lit(1)).alias("n")).collect()}
        f = heldout.in_train
        with monkeypatch.context() as m:
            m.setattr(heldout, "in_train", lambda p, b=block: f(p, b))
            got = queries.split_blocks(spark, "")
            assert {r["half"]: r["n"] for r in got.collect()} == want
    split = heldout.split_lists(text.token_lists(docs), 3, 2)
    train, test = laboratory.halves(split)
    rows = heldout.split_documents(t, 3, 2)
    for half, part in (("train", train), ("test", test)):
        assert lists.rows(part).groupBy("doc_ord", "token").count().exceptAll(rows.where(F.col("half") == half).groupBy("doc_ord", "token").count()).isEmpty()


def test_stream_counts_of_documents_that_share_a_number(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a a"), (None, "x"), (None, "x y"), (3, ""), (4, None)], "doc_id long, text string")
    monkeypatch.setattr(queries, "_table", lambda *a: docs)
    assert {tuple(r) for r in queries.token_stream_counts(spark, "").collect()} == {(1, 5, 3, 2), (2, 2, 1, 1), (None, 3, 2, 1)}
