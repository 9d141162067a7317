"""Operator 4, secret scans [native]: candidates judged by how many owners and repositories hold them.

Every whole text is searched for the three base kinds (assign, access, hex) and for `opaque` runs: long mixed-case runs of
letters and digits. Each candidate's value is hashed, and over the whole corpus the hash's distinct repositories and owners
are counted. A value that COPIED_OWNERS owners or COPIED_REPOSITORIES repositories or more hold is an example that people
copy (kind `copied`); one that fewer hold and that looks live is a credential (kind `live`). The spans of these values are added to the base spans, which stay.

Counting takes distinct (hash, owner, repository) rows first, so a value that stands in a third of all documents is one
row for each repository before any shuffle by hash; the join back is an inner equi-join whose hot side adaptive execution
splits. Only values and positions are shuffled, never texts.

Defined results: a null text counts as empty; a null owner or repository is one of its own; rows with equal doc_id stay
separate; a text of any length is searched whole, in time that grows with it; an empty table gives no rows; other columns
are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, read_table

# Kinds in their order, with the pattern, the group that holds the value, and the least length of it.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
OPAQUE = ("opaque", r"[A-Za-z0-9+/_-]{32,}", 0, 32)
ADDED = ("copied", "live")
#: Runs shorter than the least length are no candidates, so a test for one of that length spares most texts the rest.
NEEDED = {"access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "opaque": r"[A-Za-z0-9+/_-]{32}"}
COPIED_OWNERS = 3
COPIED_REPOSITORIES = 3
PLACEHOLDER = r"(?i)example|changeme|placeholder|your[_-]|xxxx|\*\*\*|1234567|abcdef"
LEAST_DISTINCT = 8

#: Matches whose places are summed in one go; sums of whole groups come on top, so the work grows with the text.
GROUP = 256

SPAN = "struct<start:long,kind:int,end:long,value:string>"


def _of(value: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f(value), with `value` worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), 0)


def _found(text: F.Column, order: int, kind: tuple[str, str, int, int]) -> F.Column:
    """Matches as structs. What stands between them comes from a split by the same pattern, so lengths give places."""
    name, pattern, group, least = kind
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(state: F.Column, x: F.Column) -> F.Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        span = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), x["value"].alias("value")))
        return F.struct(F.coalesce(end, start).cast("long").alias("at"), F.when(keep, F.concat(state["spans"], span)).otherwise(state["spans"]).cast(f"array<{SPAN}>").alias("spans"))

    def grouped(all_matches: F.Column) -> F.Column:
        """(at, spans) of each group of matches, places counted from the group's start."""
        start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(all_matches) - 1) / GROUP).cast("int")), lambda g: F.aggregate(F.slice(all_matches, g * GROUP + 1, GROUP), start, step))

    def placed(groups: F.Column) -> F.Column:
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("before"))
        before = F.aggregate(groups, start, lambda state, g: F.struct((state["at"] + g["at"]).alias("at"), F.concat(state["before"], F.array(state["at"])).alias("before")), lambda state: state["before"])
        moved = lambda g, by: F.transform(g["spans"], lambda s: F.struct((s["start"] + by).alias("start"), s["kind"].alias("kind"), (s["end"] + by).alias("end"), s["value"].alias("value")))
        return F.flatten(F.zip_with(groups, before, moved))

    spans = _of(_of(zipped, grouped), placed).cast(f"array<{SPAN}>")
    return F.when(text.rlike(NEEDED.get(name, pattern)), spans).otherwise(none)


def _joined(spans: F.Column) -> F.Column:
    names = F.array(*[F.lit(k) for k in (*(b[0] for b in BASE), *ADDED)])
    return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"], s["kind"], s["end"]))), lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: F.Column | None = None, repository: F.Column | None = None, copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """(doc_id, base, added, max_repositories): two arrays of (start, kind, end), the kinds numbered as in BASE and then
    ADDED, and the most repositories that hold one of the row's candidates, 0 without any."""
    owner = F.col("source") if owner is None else owner
    repository = F.col("source") if repository is None else repository
    named = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(F.concat(F.lit("="), owner.cast("string")), F.lit("")).alias("owner"), F.coalesce(F.concat(F.lit("="), repository.cast("string")), F.lit("")).alias("repository"))
    text = F.col("text")
    base = F.concat(*[_found(text, i, kind) for i, kind in enumerate(BASE)])
    rows = materialize(named.select(F.monotonically_increasing_id().alias("row"), "doc_id", "owner", "repository", base.alias("base"), _found(text, len(BASE), OPAQUE).alias("opaque")), "secret-rows")

    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]")
    candidates = rows.select("row", "owner", "repository", F.explode(F.concat("base", F.filter("opaque", mixed))).alias("c")).select("row", "owner", "repository", "c.start", "c.kind", "c.end", "c.value", F.xxhash64("c.value").alias("h1"), F.crc32(F.col("c.value").cast("binary")).alias("h2"))
    holders = candidates.select("h1", "h2", "owner", "repository").distinct().groupBy("h1", "h2", "owner").agg(F.count("*").alias("repositories")).groupBy("h1", "h2").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))
    value = F.col("value")
    live = (F.size(F.array_distinct(F.split(value, ""))) >= LEAST_DISTINCT) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER)
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repositories") >= copied_repositories)
    verdict = F.when(copied, F.lit(len(BASE))).when(live, F.lit(len(BASE) + 1))
    # The value ends where its match ends.
    span = F.struct((F.col("end") - F.length("value")).alias("start"), F.col("verdict").alias("kind"), F.col("end").alias("end"))
    judged = candidates.join(holders, ["h1", "h2"]).withColumn("verdict", verdict).select("row", "n_repositories", F.when(F.col("verdict").isNotNull(), span).alias("span"))
    added = judged.groupBy("row").agg(F.array_distinct(F.collect_list("span")).alias("added"), F.max("n_repositories").alias("max_repositories"))
    slim = rows.select("row", "doc_id", F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))).alias("base"))
    return slim.join(added, "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:long,kind:int,end:long>>")).alias("added"), F.coalesce("max_repositories", F.lit(0)).cast("long").alias("max_repositories"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; an owner's documents in one language stand for a repository."""
    found = scan(read_table(spark, sf_dir, "documents"), owner=F.col("source"), repository=F.col("lang"))
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{BASE[i][0]}")
    kind = lambda k: F.size(F.filter("added", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0), n(1), n(2), F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), kind(len(BASE)).alias("n_copied"), kind(len(BASE) + 1).alias("n_live"), "max_repositories")
