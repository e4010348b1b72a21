import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import similarity


def both(spark, texts):
    left = spark.createDataFrame(list(enumerate(texts)), "a long, x string")
    return left, left.toDF("b", "y")


def test_pair_exactly_at_the_threshold(spark):
    """0.56 * 25 comes to a little more than 14; the trigrams of only one of the texts are the rarest."""
    left, right = both(spark, ["abcdefghijklm", "abcdefghijklm nopqrstuvw"])
    assert {(r.a, r.b) for r in similarity.similar_pairs(left, right, "x", "y", 0.56).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


@pytest.mark.parametrize("threshold", [0.3, 0.55, 0.8, 1.0])
@pytest.mark.parametrize("part", [2, 1000])
def test_against_every_pair(spark, monkeypatch, threshold, part):
    """Short, long, equal, empty and missing texts, of keys in one part and in many."""
    monkeypatch.setattr(similarity, "PART", part)
    rng = random.Random(7)
    words = ["".join(rng.choice("abé𝒳c") for _ in range(rng.randint(1, 4))) for _ in range(12)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 1, 2, 3, 8, 30)))) for _ in range(40)]
    texts += [t[:-1] + rng.choice("abc") for t in texts[:15]] + texts[:6] * 2 + ["", None, "--", "--", None]
    left, right = both(spark, texts)
    got = sorted((r.a, r.b, r.similarity) for r in similarity.similar_pairs(left, right, "x", "y", threshold).collect())
    pairs = left.crossJoin(right).withColumn("s", similarity.similarity(F.col("x"), F.col("y"))).where(F.col("s") >= threshold)
    assert got == sorted((r.a, r.b, r.s) for r in pairs.select("a", "b", "s").collect())


def test_copies_are_compared_once(spark):
    """2,000 copies of a text: by rows, four million comparisons for each trigram looked at."""
    left, right = both(spark, ["Supplier#000000001"] * 2000 + ["Supplier#000000002"])
    found = similarity.similar_pairs(left, right, "x", "y", 0.8)
    assert found.columns == ["a", "x", "b", "y", "similarity"]
    assert tuple(found.agg(F.count("*"), F.countDistinct("a"), F.countDistinct("b")).first()) == (4_000_001, 2001, 2001)
