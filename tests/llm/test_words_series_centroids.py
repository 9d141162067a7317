"""Operators 11 to 13: the library, brute force and SQL on the smallest tables, and small tables of edge cases."""

import datetime
import hashlib
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import DATA, normal
from pyspark.sql import functions as F

from lexivec.llm import centroids, changepoints, queries, word_bpe

P = pytest.importorskip("public_tokenizers")
FILE = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in ("sale_lines", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


# --- 11 words ---


def library():
    return word_bpe.vocabulary(FILE).tokenizer


def expected(text):
    ids = library().encode(text or "", add_special_tokens=False).ids
    back = library().decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()


def test_words_agree_with_the_library():
    held = word_bpe.vocabulary(FILE)
    random.seed(2)
    signs = "ab E  \n'stmdrevlSTMDREVL.,-_09é ß²ª×÷日…\t\x00ÉÀİΣſ''́ ⱥȺ"
    texts = [None, "", "'", "''s's", "<|endoftext|> x<|startoftext|>", "DON'T we'Ll"] + ["".join(random.choice(signs) for _ in range(random.randint(0, 40))) for _ in range(500)]
    texts += ["".join(random.choice("etaoinshr ") for _ in range(80)) for _ in range(300)] + ["ab" * 400, "a" * 999]
    ids, n = held.encode_batch(pa.array(texts, pa.string()))
    for text, got in zip(texts, np.split(ids, np.cumsum(n)[:-1])):
        assert got.tolist() == held.tokenizer.encode(text or "", add_special_tokens=False).ids, repr(text)


def test_pair_test_equals_merging_both():
    held = word_bpe.vocabulary(FILE)
    random.seed(4)
    middle = [i for i in range(held.size) if held.length[i] and held.tokenizer.id_to_token(i)[-4:] != "</w>"]
    ending = [i for i in range(512, held.size) if held.length[i] and held.tokenizer.id_to_token(i)[-4:] == "</w>"]
    pairs = [(random.choice(middle), random.choice(ending)) for _ in range(2000)] + [(a, b) for a in middle[256:300] for b in ending[:40]]
    text = lambda i: held.entry_raw[held.entry_at[i] : held.entry_at[i] + held.length[i]].tobytes()
    got = held.holds(*(np.array(x) for x in zip(*pairs)))
    assert got.tolist() == [held.merged(text(a) + text(b)) == [a, b] for a, b in pairs]
    assert 0 < got.sum() < len(got)


def test_both_ways_are_taken():
    """Some words stand as proposed, others are merged exactly."""
    held = word_bpe.Vocabulary(FILE)
    held.encode_batch(pa.array(["the quick brown fox jumps over invented zorblaxian qeriosto phimmerings"]))
    assert 0 < held.exact < held.encoded


def test_query_over_all_documents(spark):
    rows = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.QUERIES["op11_word_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    assert rows == {r.doc_id: expected(r.text) for r in docs}


def test_word_edge_cases(spark):
    long = "Some words, again's " * 200_000  # goes through in parts
    texts = [(1, None), (2, ""), (2, ""), (3, " \n\t"), (None, "x"), (4, long), (5, "<|endoftext|>"), (6, "z" * 3000)]
    rows = spark.createDataFrame([(i, t, 5, "k") for i, t in texts], "doc_id long, text string, n_tokens int, ids_sha256 string")
    got = word_bpe.digest(rows, FILE).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, *expected(t))) for i, t in texts)
    assert word_bpe.digest(rows.limit(0), FILE).collect() == []
    back = word_bpe.decode(word_bpe.encode(rows.filter("doc_id <> 4"), FILE), FILE)
    for row in back.collect():
        text = next(t for i, t in texts if i == row.doc_id)
        assert row.text == library().decode(library().encode(text or "", add_special_tokens=False).ids, skip_special_tokens=False)
    odd = spark.createDataFrame([(1, [320, None, 10**6, -1, 320]), (2, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in word_bpe.decode(odd, FILE).collect()} == {1: library().decode([320, 320], skip_special_tokens=False), 2: ""}


def test_parts_of_a_long_text():
    text = "ab cd\néé " * 1000 + "x" * 500
    parts = [p[0].as_py() for p in word_bpe.parts_of(pa.scalar(text), 100)]
    assert "".join(parts) == text and len(parts) > 50 and all(p[-1] in " \n" for p in parts[:-1])


# --- 12 change points ---


def slow_cuts(x, least=14, penalty=40_000, scale=1000):
    """All ways of the last segment for every day, compared by (cost, segments, starts from the last one backwards)."""

    def cost(part):
        n, s, q = len(part), sum(part), sum(v * v for v in part)
        return n * math.floor(scale * math.log(1 + (n * q - s * s) // (n * n)))

    best = {0: (0, 0, ())}
    for j in range(1, len(x) + 1):
        found = [(best[i][0] + cost(x[i:j]) + penalty * (i > 0), best[i][1] + 1, (i, *best[i][2])) for i in range(j) if i in best and (j - i >= least or i == 0 and j == len(x))]
        if found:
            best[j] = min(found)
    return best[len(x)]


@pytest.mark.parametrize("scale", [1, 1000, 10**8])
def test_cuts_equal_brute_force(scale):
    random.seed(scale)
    series = []
    for n in [1, 2, 13, 14, 15, 27, 28, 29, 40, 63, 64, 65, 90, 130, 150]:
        level = [random.randint(0, 20) * scale for _ in range(n // 15 + 1)]
        series.append(np.array([level[i // 15] + random.randint(0, 3) * scale for i in range(n)]))
    series += [np.zeros(100, dtype=np.int64), np.full(61, 7 * scale), np.array(([0] * 20 + [50 * scale] * 20) * 3)]
    for penalty in (0, 3000, 40_000):
        got = {}
        for of, columns in changepoints.segments(series, 14, penalty):
            for k, i in enumerate(of.tolist()):
                got.setdefault(i, []).append({c: v[k] for c, v in columns.items()})
        assert sorted(got) == list(range(len(series)))
        for i, x in enumerate(series):
            cost, count, starts = slow_cuts(x.tolist(), penalty=penalty)
            rows = got[i]
            assert [r["first_day"] for r in rows][::-1] == list(starts), (i, penalty)
            assert {r["best_cost"] for r in rows} == {cost} and {r["n_segments"] for r in rows} == {count}
            assert [r["segment_no"] for r in rows] == list(range(1, count + 1))
            assert sum(r["total"] for r in rows) == int(x.sum()) and sum(r["n_days"] for r in rows) == len(x)


def test_change_points_equal_sql(spark, duck):
    got = queries.QUERIES["op12_change_points"](spark, DATA).toPandas()
    want = duck.sql(queries.SQL["op12_change_points"]).df()
    assert normal(got) == normal(want)
    assert got.n_segments.max() > 1


def test_series_edge_cases(spark):
    day = lambda n: datetime.datetime(2024, 1, 1, 5) + datetime.timedelta(days=n)
    rows = [(1, 3, day(0), "a"), (1, 3, day(0), "a"), (1, None, day(90), "b"), (1, 5, None, "b"), (None, 2, day(3), "c"), (2, None, None, "d"), (3, 1, day(0), ""), (3, 1, day(29), None)]
    # A hot key of two levels, with equal rows.
    rows += [(9, 1 + 100 * (k >= 40), day(k), "h") for k in range(80) for _ in range(5)]
    table = spark.createDataFrame(rows, "vendor_id int, quantity int, shipped_at timestamp, total string").withColumn("value", F.lit("clash")).withColumn("day", F.lit(0)).withColumn("key", F.lit("k"))
    got = changepoints.change_points(table, "vendor_id", "shipped_at", "quantity").orderBy("key", "segment_no").collect()
    first = (datetime.date(2024, 1, 1) - datetime.date(1970, 1, 1)).days
    assert [(r.key, r.segment_no, r.first_day - first, r.n_days, r.total, r.n_segments) for r in got] == [
        (None, 1, 3, 1, 2, 1), (1, 1, 0, 1, 6, 1), (3, 1, 0, 30, 2, 1), (9, 1, 0, 40, 200, 2), (9, 2, 40, 40, 40 * 505, 2)]
    assert got[-1].best_cost == 40_000 and got[-1].cost == 0 and got[-1].spread == 1
    assert changepoints.change_points(table.limit(0), "vendor_id", "shipped_at", "quantity").collect() == []


def test_long_series_in_blocks():
    """Eleven years of days; only blocks of BLOCK x BLOCK are held."""
    x = np.repeat(np.array([5, 900, 40, 7000] * 10), 100) + np.arange(4000) % 3
    of, columns = next(changepoints.segments([x]))
    assert columns["first_day"].tolist() == list(range(0, 4000, 100)) and set(of) == {0}


# --- 13 centroids ---


def test_centroids_equal_sql(spark, duck):
    got = queries.QUERIES["op13_centroids"](spark, DATA).toPandas()
    assert normal(got) == normal(duck.sql(queries.SQL["op13_centroids"]).df())
    assert got.cluster.nunique() > 5


def slow_clusters(v, at, rounds):
    for turn in range(rounds + 1):
        d = ((v[:, None, :] - at[None]) ** 2).sum(axis=2)
        own = d.argmin(axis=1)
        if turn < rounds:
            at = np.array([[int(s) // int((own == k).sum()) for s in v[own == k].sum(axis=0)] if (own == k).any() else at[k].tolist() for k in range(len(at))])
    return own, d[np.arange(len(v)), own], at


def test_bounds_spare_scans_and_change_nothing():
    rng = np.random.default_rng(1)
    middle = rng.integers(-200, 200, (12, 8))
    v = (middle[rng.integers(0, 12, 4000)] + rng.integers(-9, 10, (4000, 8))).astype(np.int64)
    v[2000:2400] = v[0]  # repeated rows
    at, before, scanned = v[:15].copy(), None, []
    at[3] = at[2]  # two equal centroids: the smaller number gets all
    start = at.copy()
    own, up, low = np.full(len(v), -1), np.zeros(len(v)), np.zeros(len(v))
    for turn in range(7):
        own, up, low, far, n = centroids.assign(v, own, up, low, centroids.moved(at, before), exact=turn == 6)
        scanned.append(n)
        true = np.sqrt(((v - at[own]) ** 2).sum(axis=1))
        assert (up >= true).all()
        if turn < 6:
            before = at
            at = np.array([[int(s) // int((own == k).sum()) for s in v[own == k].sum(axis=0)] if (own == k).any() else at[k].tolist() for k in range(len(at))])
    want, distance, final = slow_clusters(v, start, 6)
    assert (own == want).all() and (far == distance).all() and (at == final).all()
    assert scanned[0] == 4000 and scanned[-1] < 2000


def test_vector_edge_cases(spark):
    wide = lambda x: [float(x)] * 64
    rows = [(1, wide(1), 0), (1, wide(1), 0), (2, wide(-1), 1), (None, wide(1), 2), (3, None, 0), (4, [], 0), (5, [1.0] * 63, 0), (6, [1.0] * 63 + [None], 0), (7, [float("nan")] * 64, 0), (8, [float("inf")] * 64, 0), (9, wide(3e30), 0), (10, wide(0.0039), None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int").withColumn("v", F.lit("clash")).withColumn("distance", F.lit(1))
    state, at = centroids.cluster(table)
    got = state.select("vec_id", "cluster", "distance").collect()
    assert sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 2, 10] and {r.distance for r in got} == {0} and len(at) == 5
    assert len({r.cluster for r in got if r.vec_id in (1, None)}) == 1
    assert sorted(x[0] for x in at.tolist()) == [-256, 0, 256, 256, 256]
    few, _ = centroids.cluster(table, k=1, rounds=2)
    assert {r.cluster for r in few.collect()} == {0}
    none, at = centroids.cluster(table.limit(0))
    assert none.collect() == [] and len(at) == 0
