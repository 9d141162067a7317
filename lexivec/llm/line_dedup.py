"""Operator 7, line dedup [native]: content-defined chunks of lines, and what repeats beyond their ends.

Taken out is each run of two lines or more, and each line of LONG_WORDS words or more, that stands at an earlier place (by
id, then place) too. What surrounds a passage makes no difference.

1. Lines are hashed, and a rolling hash over WINDOW line hashes ends a chunk where its low bits are zero (one line in DIVISOR
   on average), so boundaries depend on nearby content alone and come back after lines are put in or taken out. Chunks of
   two lines or more are counted over the whole corpus by two hashes; of those that repeat, every occurrence but the first
   is compared with the first byte by byte, and goes if it is equal. Long passages go here, a row for each chunk.
2. Chunk ends cut the first and last lines of a passage away with its surroundings, and a short passage may hold no whole
   chunk. A run repeats where each two neighbouring lines of it do, so the same is done with pairs of neighbours, and with
   single long lines, that lie in no chunk of step 1 that goes. This extends matched chunks line by line to the ends of
   what repeats. Pairs inside a chunk that goes are never first occurrences, so leaving them out changes nothing.

A pair that overlaps its own first occurrence stays. As places are those of the texts before the cut, a run may go whose
first occurrence loses lines to a still earlier one; the first occurrence of each line stays.

Hashes and places are written once for each step; texts are cut again only for documents that hold something repeated.
Tables of repeated units are broadcast only when they are small; otherwise the joins shuffle. Every step is linear in a
text's lines.

Defined results: a null text stays null; an empty text, or one of a single short line, stays as it is; rows with equal id
and text are treated alike, so a first occurrence stays in all of them; units whose hashes agree but whose bytes differ
from the first stay; a null id comes first; an empty table gives no rows; other columns are carried along, and columns of
this operator give way to theirs in name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, free_name, materialize, read_table

#: Lines under the rolling hash, and a power of two: the lines of a chunk on average.
WINDOW, DIVISOR = 3, 4
LONG_WORDS = 50
BROADCAST_ROWS = 300_000
BROADCAST_BYTES = 32 << 20


def _words(line: F.Column) -> F.Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _hash2(values: F.Column) -> list[F.Column]:
    return [F.xxhash64(values).alias("h1"), F.hash(values).alias("h2")]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, order_id, th, lines) of texts that aren't null."""
    text = F.col(text_col)
    return docs.filter(text.isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("order_id"), F.xxhash64(text).alias("th"), F.split(text, "\n", -1).alias("lines"))


def _each(rows: DataFrame, units: F.Column) -> DataFrame:
    """A row (id, order_id, th, at, n, h1, h2) for each unit: n lines from place `at`."""
    return rows.select("id", "order_id", "th", F.explode(units).alias("u")).select("id", "order_id", "th", "u.*")


def _chunk_units(keyed: DataFrame) -> DataFrame:
    """Chunks of two lines or more."""
    rows = keyed.select("id", "order_id", "th", F.transform("lines", lambda x: F.xxhash64(x)).alias("hs"))

    def ends(x: F.Column, i: F.Column) -> F.Column:
        rolled = x
        for k in range(1, WINDOW):
            rolled = rolled.bitwiseXOR(F.shiftrightunsigned(F.coalesce(F.get("hs", i - k), F.lit(0).cast("long")), 7 * k))
        return rolled.bitwiseAND(F.lit(DIVISOR - 1)) == 0

    rows = rows.withColumn("marks", F.transform("hs", lambda x, i: F.when(ends(x, i) | (i == F.size("hs") - 1), i)))
    rows = rows.select("id", "order_id", "th", "hs", F.filter("marks", lambda x: x.isNotNull()).alias("ends"))
    rows = rows.withColumn("spans", F.transform("ends", lambda e, k: F.struct((F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 1).alias("at"), (e - F.coalesce(F.get("ends", k - 1), F.lit(-1))).alias("n"))))
    rows = rows.withColumn("spans", F.filter("spans", lambda s: s["n"] >= 2))
    return _each(rows, F.transform("spans", lambda s: F.struct(s["at"], s["n"], *_hash2(F.slice("hs", s["at"] + 1, s["n"])))))


def _pair_units(keyed: DataFrame) -> DataFrame:
    """Pairs of neighbours and long lines at the places of the array `open`."""
    rows = keyed.select("id", "order_id", "th", F.transform("lines", lambda x: F.struct(F.xxhash64(x).alias("h"), (_words(x) >= LONG_WORDS).alias("long"))).alias("ls"), "open")
    unit = lambda i, n, *hs: F.struct(i.alias("at"), F.lit(n).alias("n"), *_hash2(F.array(*hs)))
    h = lambda i: F.get("ls", i)["h"]
    pairs = F.transform(F.filter("open", lambda i: i < F.size("ls") - 1), lambda i: unit(i, 2, h(i), h(i + 1)))
    longs = F.transform(F.filter("open", lambda i: F.get("ls", i)["long"]), lambda i: unit(i, 1, h(i)))
    return _each(rows, F.concat(pairs, longs))


def _broadcast_few(df: DataFrame, column: str | None = None) -> DataFrame:
    """`df` to be broadcast if its rows, and the bytes of a column, are few."""
    got = df.agg(F.count("*").alias("n"), F.sum(F.octet_length(column) if column else F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if got.n <= BROADCAST_ROWS and (got.bytes or 0) <= BROADCAST_BYTES else df


def _by_text(rows: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """Rows with id and th, joined with a row of `lists` (_id, _th, ...) for each text."""
    return rows.join(lists, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), how)


def _gone(each: DataFrame, keyed: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, th, at, n) of the units that stand at an earlier place too, byte for byte."""
    each = scratch.keep(each, name)
    place = F.struct("order_id", "th", "at")
    repeated = each.groupBy("h1", "h2", "n").agg(F.count("*").alias("times"), F.min(place).alias("first")).filter("times > 1").drop("times")
    repeated = scratch.keep(repeated, f"{name}-repeated")
    hit = each.join(_broadcast_few(repeated), ["h1", "h2", "n"]).withColumn("is_first", place.eqNullSafe(F.col("first")))
    # The lines of a pair that begins where its first occurrence ends are that occurrence's own.
    overlaps = F.col("order_id").eqNullSafe(F.col("first.order_id")) & (F.col("th") == F.col("first.th")) & (F.col("at") < F.col("first.at") + F.col("n"))
    hit = scratch.keep(hit.filter(F.col("is_first") | ~overlaps).select("id", "th", "at", "n", "h1", "h2", "is_first"), f"{name}-hits")

    def cut(which: DataFrame) -> DataFrame:
        """(h1, h2, n, id, th, at, unit): the lines of hits, from the texts that hold them."""
        lists = which.groupBy("id", "th").agg(F.collect_set(F.struct("at", "n", "h1", "h2")).alias("hits")).withColumnsRenamed({"id": "_id", "th": "_th"})
        found = _by_text(keyed.select("id", "th", "lines"), _broadcast_few(scratch.keep(lists, f"{name}-lists")), "inner")
        found = found.select("id", "th", F.transform("hits", lambda s: F.struct(s["h1"], s["h2"], s["n"], s["at"], F.array_join(F.slice("lines", s["at"] + 1, s["n"]), "\n").alias("unit"))).alias("units"))
        return found.select("id", "th", F.inline("units"))

    held = cut(hit.filter("is_first")).groupBy("h1", "h2", "n").agg(F.first("unit").alias("held"))
    held = scratch.keep(held, f"{name}-first", "zstd")
    gone = cut(hit.filter("not is_first")).join(_broadcast_few(held, "held"), ["h1", "h2", "n"]).filter("unit = held")
    return scratch.keep(gone.select("id", "th", "at", "n").distinct(), f"{name}-gone")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with every repeated run of lines taken out of the text, and a column `removed` (or a longer name) with the
    number of lines taken out."""
    scratch = Scratch()
    keyed = _keyed(docs, id_col, text_col)
    chunks = _gone(_chunk_units(keyed), keyed, scratch, "chunks")
    every = F.sequence(F.lit(0), F.size("lines") - 1)
    # Places where a pair or a long line begins inside a chunk that goes.
    inside = chunks.groupBy("id", "th").agg(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 2))).alias("inside"))
    inside = scratch.keep(inside.withColumnsRenamed({"id": "_id", "th": "_th"}), "inside")
    if inside.count() <= BROADCAST_ROWS:
        opened = _by_text(keyed, F.broadcast(inside), "left").select(*keyed.columns, F.when(F.col("inside").isNull(), every).otherwise(F.array_except(every, "inside")).alias("open"))
    else:
        # Leaving pairs out only saves time; it isn't worth a shuffle of the texts.
        opened = keyed.withColumn("open", every)
    pairs = _gone(_pair_units(opened), keyed, scratch, "pairs")
    places = chunks.unionByName(pairs).groupBy("id", "th").agg(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))).alias("gone"))
    out = _without(docs, scratch, places, id_col, text_col)
    scratch.clear()
    return out


def _without(docs: DataFrame, scratch: Scratch, places: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`docs` without the lines that `places` (id, th, gone) numbers, and their number in a last column."""
    names = {n: free_name(docs, n) for n in ("removed", "_id", "_th", "_gone")}
    gone = materialize(places.toDF(names["_id"], names["_th"], names["_gone"]), "removed", "lz4")
    text, flags = F.col(text_col), F.col(names["_gone"])
    joined = docs.join(_broadcast_few(gone), F.col(id_col).cast("string").eqNullSafe(F.col(names["_id"])) & (F.xxhash64(text) == F.col(names["_th"])), "left")
    lines = F.split(text, "\n", -1)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), flags), lambda i: F.get(lines, i))
    columns = [F.when(flags.isNotNull(), F.array_join(kept, "\n")).otherwise(text).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*columns, F.coalesce(F.size(flags), F.lit(0)).cast("long").alias(names["removed"]))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_before"))
    return dedup_lines(docs).select("doc_id", "n_before", F.length("text").cast("long").alias("n_after"), "removed", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# Each pair of neighbouring lines, and each long line, looks for its first occurrence; lines under a later one go.
OP7_SQL = f"""
WITH line AS (
  SELECT doc_id, i, ls[i] AS line, ls[i + 1] AS following
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
), unit AS (
  SELECT doc_id, i, 2 AS n, line || chr(10) || following AS unit FROM line WHERE following IS NOT NULL
  UNION ALL SELECT doc_id, i, 1, line FROM line WHERE length(line) - length(replace(line, ' ', '')) + 1 >= {LONG_WORDS}
), placed AS (
  SELECT *, first_value(doc_id) OVER u AS first_doc, first_value(i) OVER u AS first_i FROM unit WINDOW u AS (PARTITION BY unit ORDER BY doc_id, i)
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM placed WHERE doc_id <> first_doc OR i >= first_i + n
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text, count(g.i) AS removed
  FROM line l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id
)
SELECT d.doc_id, length(d.text)::BIGINT AS n_before, length(k.text)::BIGINT AS n_after, coalesce(k.removed, 0)::BIGINT AS removed, sha256(k.text) AS text_sha256
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
