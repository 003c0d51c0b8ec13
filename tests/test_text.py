import unicodedata

import pytest
from pyspark.sql import functions as F

from vocarium.functions import text
from vocarium.operators import vocab


def toks(spark, s, **options):
    return spark.createDataFrame([(s,)], "t string").select(text.token_array(F.col("t"), **options).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("Call me Ishmael. Some years ago—", ["call", "me", "ishmael", "some", "years", "ago"]),
        ("the whale's o'clock", ["the", "whale's", "o'clock"]),
        ("chapter 42 loomings", ["chapter", "loomings"]),
        ("'tis", ["tis"]), ("", []), (None, []), ("the whale’s", ["the", "whale's"]), ("Straße", ["stra", "e"]), ("été", ["ete"]),
    ],
)
def test_tokens(spark, source, want):
    assert toks(spark, source) == want


def test_options(spark):
    assert toks(spark, "The Whale", lowercase=False) == ["The", "Whale"]
    assert toks(spark, "Mercédès") == ["mercedes"]
    assert toks(spark, "Mercédès", fold=False) == ["merc", "d", "s"]
    assert toks(spark, "don't stop", split_clitics=True) == ["don", "'t", "stop"]
    assert toks(spark, "WHALE'S", lowercase=False, split_clitics=True) == ["WHALE'S"]


def test_fast_fold_equals_the_decomposition(spark):
    letters = "".join(chr(c) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0xFF21, 0x212A])
    df = spark.createDataFrame([(letters,)], "t string")
    fast, exact = df.select(text.normalise(F.col("t")), text.normalise(F.col("t"), exact=True)).first()
    plain = lambda s: [c for c in s if c.isascii() and c.isalpha()]
    bare = ["".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)) for c in letters]
    several = sum(len(plain(b)) for b in bare if len(b) > 1)
    assert len(plain(exact)) - len(plain(fast)) == several  # only signs of several characters differ


def test_boilerplate(spark):
    for word in ("THE", "THIS"):
        s = f"pre\n*** START OF {word} PROJECT GUTENBERG EBOOK X ***\nbody\n*** END OF {word} PROJECT GUTENBERG EBOOK X ***\npost"
        got = spark.createDataFrame([(s,), ("plain",)], "t string").select(text.strip_boilerplate(F.col("t")).alias("t")).collect()
        assert [r["t"] for r in got] == ["\nbody\n", "plain"]


def test_vocabulary_ties_nesting_and_positions(spark):
    t = spark.createDataFrame([(k // 10, k, w) for k, w in enumerate(["the"] * 10 + ["whale"] * 6 + ["sea"] * 6 + ["rare"])], "doc_ord long, pos int, token string")
    v = vocab.build_vocab(t, 10, 2)
    assert [r["word"] for r in v.orderBy("id").collect()] == ["the", "sea", "whale"]
    assert v.agg(F.sum("n")).first()[0] == 22
    assert [r["word"] for r in vocab.build_vocab(t, 2, 1).orderBy("id").collect()] == ["the", "sea"]
    ids = vocab.encode(t, vocab.narrowed(v, 2)).orderBy("gpos").collect()
    assert [r["gpos"] for r in ids] == list(range(16))
    assert [r["id"] for r in ids] == [0] * 10 + [1] * 6
    assert vocab.coverage(t, v).first()["kept"] == 22
