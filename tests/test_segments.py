"""Segmented tables and the segmented index equal a full rebuild after any edits; searches by tiers equal plain ones."""

import random

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from lexivec.operators import lexical
from lexivec.operators.segments import FANOUT, SegmentedTable
from lexivec.plans import registry

WORDS = [f"w{i}" for i in range(30)]


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_table_equals_its_history(spark, tmp_path):
    random.seed(1)
    table, held = SegmentedTable(spark, str(tmp_path / "t"), "path string, line int, v string", "path", sort=["path"]), {}
    sizes = []
    for turn in range(9):
        gone = random.sample(sorted(held), min(len(held), random.randint(0, 3)))
        fresh = {p: [(p, n, f"{turn}") for n in range(random.randint(1, 3))] for p in {random.choice("abcdefghij") for _ in range(2)} - (set(held) - set(gone))}
        for p in gone:
            del held[p]
        held |= fresh
        before = {s.name for s in table.segments}
        table = table.appended(spark.createDataFrame([r for rows in fresh.values() for r in rows], table.schema), spark.createDataFrame([(p,) for p in gone], "path string"))
        written = [s for s in table.segments if s.name not in before]
        assert sum(s.rows for s in written) == sum(map(len, fresh.values())) and len(written) <= 1
        table = SegmentedTable(spark, table.folder, table.schema, "path", table.compacted().listed(), table.sort)
        sizes.append(len(table.segments))
        assert rows_of(table.read()) == sorted(r for rows in held.values() for r in rows)
    assert max(sizes) <= FANOUT and len(table.compacted(full=True).segments) <= 1
    assert rows_of(table.compacted(full=True).read()) == rows_of(table.read())
    assert rows_of(SegmentedTable(spark, str(tmp_path / "none"), table.schema, "path").read()) == []


def test_index_equals_a_rebuild_after_random_edits(spark, tmp_path):
    random.seed(2)
    schema = "chunk_id string, path string, language string, content string"
    text = lambda: " ".join(random.choices(WORDS, weights=[40 - i for i in range(30)], k=random.randint(0, 25)))
    held = {f"c{i}": (f"c{i}", f"src/f{i}.rs", random.choice(["rust", "go"]), text()) for i in range(40)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    index = lexical.Index.build(frame(held.values()), str(tmp_path / "lsm"))
    for turn in range(4):
        gone = random.sample(sorted(held), 3)
        fresh = [(c, held[c][1], "go", text()) for c in gone[:2]] + [(f"n{turn}", f"src/n{turn}.go", "go", text())]
        old = [held.pop(c) for c in gone]
        held |= {r[0]: r for r in fresh}
        rows = {s.name for s in index.segments}
        index = index.updated(frame(fresh), frame(old))
        assert sum(s.rows for s in index.segments if s.name not in rows) == sum(len(set(r[3].split())) for r in fresh)
        index = index.compacted()
        index = lexical.Index(spark, index.folder, "string", index.listed())
        if turn == 3:
            whole, chunks = lexical.Index.build(frame(held.values()), str(tmp_path / f"whole{turn}")), frame(held.values())
            assert (index.total, index.average) == (whole.total, whole.average)
            for query in ("w0 OR w5 OR w29", '"w0 w1"', "w1 NOT w2", "w2*", "NEAR(w0 w3, 2)"):
                one, two = (rows_of(lexical.search(chunks, query, 20, literal=False, digits=9, index=i)) for i in (index, whole))
                assert one == two, query
            df = lambda i: {r.term: r.n for r in i.terms.groupBy("term").agg(F.sum("n").alias("n")).filter("n <> 0").collect()}
            assert df(index) == df(whole)
    full = index.compacted(full=True)
    assert len(full.segments) == 1 and full.segments[0].gone == 0
    assert rows_of(lexical.search(chunks, "w0 OR w7", 20, literal=False, digits=9, index=full)) == rows_of(lexical.search(chunks, "w0 OR w7", 20, literal=False, digits=9, index=index))


@pytest.fixture(scope="module")
def tiered(spark, tmp_path_factory):
    """One word is in every chunk, some are rare, and many chunks are equal."""
    random.seed(3)
    rows = []
    for i in range(6000):
        n = random.randint(1, 30)
        rows.append((i, f"src/f{i % 50}.rs" if i % 97 else f"tests/f{i}.rs", "rust" if i % 3 else "go", "the " * random.randint(1, 6) + " ".join(random.choices(WORDS[:8], k=n)) + (" rare" if i % 700 == 5 else "")))
    rows += [(10_000 + i, "src/same.rs", "go", "the same text") for i in range(1500)]
    chunks = spark.createDataFrame(rows, "chunk_id long, path string, language string, content string")
    return chunks, lexical.Index.build(chunks, str(tmp_path_factory.mktemp("tiers") / "index"))


@pytest.mark.parametrize("query", ["the", "the OR rare", "rare", "w1 OR w2 OR the OR the", "same OR missing", "the OR w0"])
def test_tiers_give_the_same_rows(spark, tiered, query):
    chunks, index = tiered
    words = lexical._any_words(lexical.parse(query))
    for limit, languages in ((1, None), (20, ["go"]), (7000, None)):
        reading = lexical.Reading()
        got = index.best_of_any(words, limit, 6, languages, worth=0, reading=reading).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(limit)
        want = index.scored(lexical.parse(query)).filter("not hidden")
        want = want.filter(F.col("language").isin(languages)) if languages else want
        want = want.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(limit)
        assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.select("chunk_id", "score").collect()], (limit, languages)


def test_a_frequent_word_is_read_in_part(tiered):
    _, index = tiered
    reading = lexical.Reading()
    assert index.best_of_any(["the"], 20, worth=0, reading=reading).count() >= 20
    assert reading.of == 7500 and reading.rows < 0.3 * reading.of


def test_tiers_of_real_documents(spark):
    index = registry.held_index(spark, DATA)
    for words in (["the"], ["idiot", "clown", "trash"]):
        got = index.best_of_any(words, 50, 6, worth=0).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "chunk_id").limit(50)
        want = lexical.search(registry.corpus(spark, DATA), " OR ".join(words), 50, literal=False, digits=6, index=index)
        assert rows_of(got.select("chunk_id", "score")) == rows_of(want.select("chunk_id", "score"))
