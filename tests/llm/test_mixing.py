import duckdb
import pytest
from pyspark.sql import functions as F

from callscope.llm.mixing import ORACLE, Mix, mix_documents, mixed_copies, schedule, source_targets


def filled(sizes, weights):
    """Reshare until no source is above three times its size."""
    total, full = sum(sizes), set()
    while True:
        left = total - sum(3 * sizes[k] for k in full)
        w = sum(weights[k] for k in range(len(sizes)) if k not in full)
        target = [3 * sizes[k] if k in full else left * weights[k] / w for k in range(len(sizes))]
        over = {k for k in range(len(sizes)) if target[k] > 3 * sizes[k]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1000, 1, 1, 1], [5, 0, 7, 100, 3, 900], [1], [3, 100000, 50, 50, 2]])
def test_targets_equal_resharing(spark, sizes):
    rows = [(f"s{k:03}", s) for k, s in enumerate(sizes)]
    got = source_targets(spark.createDataFrame(rows, "source string, size long")).orderBy("sid").collect()
    assert [r.target for r in got] == pytest.approx(filled(sizes, [k % 3 + 1 for k in range(len(sizes))]))


def rows():
    out = [(k, "word " * (k % 50) + "x", f"s{k % 7}" if k % 3 else "big") for k in range(700)]
    return out + [(5000, None, "s1"), (5001, "a b", None), (5001, "a b", None), (None, "q r s", "s2"), (5002, "", "only-empty"), (5003, "long " * 9000, "s3"), (5004, " \t\n", "")]


def test_taken_words_follow_the_targets_and_the_sql(spark):
    docs = spark.createDataFrame([(*r, 9) for r in rows()], "doc_id long, text string, source string, size int").repartition(3)
    got = mix_documents(docs)
    assert got.count() == len(rows())
    assert got.where("taken > 3 * size").count() == 0
    per = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= max(1, 0.01 * r.target) or r.target < 1 for r in per)
    documents = docs.toArrow()  # noqa: F841
    want = duckdb.sql(ORACLE).fetchall()
    order = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=order) == sorted(want, key=order)
    assert sorted(map(tuple, mix_documents(docs.repartition(5)).collect()), key=order) == sorted(want, key=order)


def test_schedule_is_even_everywhere(spark):
    targets = source_targets(spark.createDataFrame([("a", 100_000), ("b", 100_000), ("c", 100_000)], "source string, size long"))
    slots = schedule(targets, Mix(slots=6000)).toPandas().sort_values("slot")
    for low in range(0, 6000, 600):
        part = slots[(slots.slot >= low) & (slots.slot < low + 600)].sid.value_counts()
        assert all(abs(part[k] - 100 * (k + 1)) <= 5 for k in range(3))


def test_copies(spark):
    docs = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    out = mixed_copies(docs)
    assert out.columns == docs.columns
    assert 0.9 < out.agg(F.sum(F.size(F.split("text", " ")))).first()[0] / docs.agg(F.sum(F.size(F.split("text", " ")))).first()[0] < 1.1
    assert mixed_copies(docs.limit(0)).count() == 0 and mix_documents(docs.limit(0)).count() == 0
