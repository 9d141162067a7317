"""The vector index gives the rows of the exact scan, and reads fewer files for them."""

import math

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lexivec.operators import ivf, vector
from lexivec.plans import registry


@pytest.fixture(scope="module")
def grouped(spark, tmp_path_factory):
    """Forty groups of vectors, one of them with a third of all rows, all equal."""
    rng = np.random.default_rng(5)
    middle = rng.normal(size=(40, 16))
    rows = [(i, (middle[i % 40] + 0.1 * rng.normal(size=16)).tolist()) for i in range(2000)]
    rows += [(5000 + i, middle[7].tolist()) for i in range(1000)]
    table = spark.createDataFrame(rows, "key long, vector array<double>")
    return table, ivf.VectorIndex.build(table, str(tmp_path_factory.mktemp("ivf") / "index"), cells=40), middle


def same(spark, table, index, query, limit, digits=6, **more):
    want = [(r.key, r.score) for r in vector.top_k(table, query, limit, key="key", digits=digits).collect()]
    rows = index.top_k(query, limit, digits=digits, **more).collect()
    assert [(r.key, r.score) for r in rows] == want
    return rows


@pytest.mark.parametrize("limit", [1, 20, 200])
def test_equals_the_exact_scan(spark, grouped, limit):
    table, index, middle = grouped
    for q in (middle[3], middle[7], middle[1] + middle[2], np.ones(16)):
        assert all(r.exact for r in same(spark, table, index, q.tolist(), limit))


def test_reads_few_cells_and_files(spark, grouped):
    table, index, middle = grouped
    reading = ivf.Reading()
    index.top_k(middle[3].tolist(), 10, digits=6, reading=reading).collect()
    assert 1 <= len(reading.opened) <= 3 and reading.coded_cells < reading.cells / 2
    files = index.exact.filter(F.col("cell").isin(reading.opened)).select(F.input_file_name()).distinct().count()
    assert 0 < files < len(index.exact.inputFiles()) / 4


def test_probes_say_whether_they_suffice(spark, grouped):
    table, index, middle = grouped
    assert {r.exact for r in index.top_k(middle[3].tolist(), 5, probes=3).collect()} == {True}
    across = (middle[3] + middle[4] + middle[5]).tolist()
    assert {r.exact for r in index.top_k(across, 60, probes=1).collect()} == {False}


def test_filter_comes_before_the_cut(spark, grouped):
    table, index, middle = grouped
    want = vector.top_k(table, middle[3].tolist(), 7, key="key", digits=6, where=F.col("key") % 3 == 0).collect()
    got = index.top_k(middle[3].tolist(), 7, digits=6, where=F.col("key") % 3 == 0).select("key", "score").collect()
    assert [tuple(r) for r in got] == [tuple(r) for r in want]


def test_real_vectors_open_fewer_files(spark):
    index = registry.held_vectors(spark, DATA)
    reading = ivf.Reading()
    index.top_k(registry.query_vector(spark, DATA), 5, digits=6, reading=reading).collect()
    assert 0 < len(reading.opened) < reading.cells


def test_rows_that_are_no_vectors(spark, tmp_path):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [math.inf, 1.0]), (8, []), (1, [1.0, 0.0])]
    table = spark.createDataFrame(rows, "key int, vector array<double>")
    index = ivf.VectorIndex.build(table, str(tmp_path / "a"))
    assert [(r.key, r.score) for r in index.top_k([2.0, 0.0], 9).collect()] == [(1, 1.0), (1, 1.0), (2, 0.0)]
    assert index.top_k([0.0, 0.0], 3).collect() == [] and index.top_k([1.0, 0.0], 0).collect() == []
    assert ivf.VectorIndex.build(table.limit(0), str(tmp_path / "b")).top_k([1.0, 0.0], 3).collect() == []


def test_a_replaced_table_is_seen(spark, tmp_path):
    """What is held of a table goes with its files."""
    for text in ("old words", "new words"):
        spark.createDataFrame([(1, text, "en", "a", 9)], "doc_id long, text string, lang string, source string, n_chars long").write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        found = registry.lexical.search(registry.corpus(spark, str(tmp_path)), text.split()[0], index=registry.held_index(spark, str(tmp_path)))
        assert found.count() == 1
