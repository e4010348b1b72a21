import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.search import fts


def test_stems_are_remembered():
    """A word's stem is found once, not at each place; what is kept is bounded."""
    fts.porter.cache_clear()
    for _ in range(50):
        fts.vector("The running rings of the plates")
    assert fts.vector("abc" * 30 + "ing") == [("abc" * 30, [1])]
    assert fts.porter.cache_info().misses == 3 and fts.porter.cache_info().maxsize == fts.REMEMBERED


def test_texts_of_a_batch_are_looked_at_once(spark):
    """The step gets each different text of a batch once, whatever is done with it."""
    seen = []
    each = fts._of_each_text("string", lambda texts: seen.append(list(texts)) or pa.array([t.upper() for t in texts], pa.string()))
    assert each.func(pa.array(["a", None, "b", "a", "", None])).to_pylist() == ["A", None, "B", "A", "", None]
    assert seen == [["a", "b", ""]]
    assert each.func(pa.array([None, None], pa.string())).to_pylist() == [None, None] and each.func(pa.array([], pa.string())).to_pylist() == []


@pytest.mark.parametrize("size", [1, 3, 10000])
def test_vectors_of_texts(spark, size):
    """Missing, empty and repeated texts, those of stop words only, long ones, over batches of several sizes."""
    long = " ".join(f"word{i % 700} Running" for i in range(9000))
    texts = ["The fat cats", None, "", "the of", "The fat cats", "well-known é 𝒳", long, None, long, "it's O'Neil's"] * 3
    raw = ["'b c':3,1 a:2 d", "", None, "x"]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(size))
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
        rows = df.select("id", fts.to_tsvector()("t").alias("v"), fts.ts_headline(fts.to_tsquery("cat"))("t").alias("h")).collect()
        plain = spark.createDataFrame([(t,) for t in raw], "t string").coalesce(1).select(fts.raw_tsvector()("t").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    got = {r.id: r.v and [(x.word, x.positions) for x in r.v] for r in rows}
    assert got == {i: t if t is None else fts.vector(t) for i, t in enumerate(texts)}
    assert rows[0].h == "The fat <b>cats</b>" and {r.h for r in rows if texts[r.id] is None} == {None}
    assert [r.v if r.v is None else [(x.word, x.positions) for x in r.v] for r in plain] == [None if t is None else fts.parse_tsvector(t) for t in raw]


def test_missing_text_without_a_type(spark):
    assert spark.range(2).select(fts.to_tsvector()(F.lit(None)).alias("v"), fts.ts_headline(None)(F.lit(None)).alias("h")).distinct().collect() == [(None, None)]
