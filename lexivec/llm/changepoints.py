"""Operator 12, penalised change points of daily series by a divide-and-conquer search.

Spark sums the values of each (key, day) with map-side partial sums, so a key with a third of all rows is spread over its
days, and then gathers one row for each key: its days and sums. Such a row grows with the calendar, never with the input.
Tasks take these rows in batches and cut many series side by side with numpy.

best(j) is the least key (cost, segments, start) of the first j days. `_solve` works out the left half of a range, pushes its
contributions into the right half in blocks of BLOCK x BLOCK (a min-plus product of what is known with the costs of all
segments between them), and goes on with the right half. Halves of `least` days or fewer hold no segment and need no work.
Cost and count of segments share one integer; contributions come in ascending order of their start and only a smaller key
replaces one, so of equal ones the earliest start stays, and with it the earliest starts of all segments before.

Numbers are exact: doubles where all products stay below 2**52, 64-bit integers below 2**62, Python's integers beyond.

Defined results: rows without a day or a value are left out; repeated rows count as often as they come; a null key is a key
of its own; a series shorter than `least` is one segment; an empty table gives no rows; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytetext import tidy
from .shared import read_table

LEAST_DAYS, PENALTY, SCALE = 14, 40_000, 1000
BLOCK = 64
#: Cells of a block over all series that are cut side by side.
CELLS = 1 << 20
#: Bits for the number of segments below the cost.
COUNT_BITS = 20
NEVER = np.int64(1) << 62

SEGMENT_SCHEMA = "segment_no int, first_day long, n_days long, total long, spread long, cost long, n_segments long, best_cost long"


def _kind(most: int, days: int) -> type:
    """The narrowest exact type for sums of squares of values up to `most` over `days`, times `days`."""
    top = (most * days) ** 2
    return np.float64 if top < 1 << 52 else np.int64 if top < 1 << 62 else object


def _spread(n: np.ndarray, total: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """1 + floor of the variance, in the type of the sums. Quotients of whole doubles below 2**52 are floored right."""
    above, below = n * squares - total * total, n * n
    return 1 + (np.floor(above / below) if above.dtype == np.float64 else above // below)


def _cost(n: np.ndarray, spread: np.ndarray, scale: int) -> np.ndarray:
    return n.astype(np.int64) * np.floor(scale * np.log(spread.astype(np.float64))).astype(np.int64)


class _Series:
    """Series of about one length, padded with zeros to the longest, and the best ways to cut their beginnings."""

    def __init__(self, values: np.ndarray, kind: type, least: int, penalty: int, scale: int):
        zero = np.zeros((len(values), 1), dtype=kind)
        held = values.astype(kind)
        self.kind, self.least, self.penalty, self.scale = kind, least, penalty, scale
        self.sums, self.squares = (np.concatenate([zero, np.cumsum(x, axis=1, dtype=kind)], axis=1) for x in (held, held * held))
        self.best = np.full(self.sums.shape, NEVER, dtype=np.int64)
        self.best[:, 0] = 0
        self.start = np.zeros(self.sums.shape, dtype=np.int32)
        self._solve(0, self.sums.shape[1])

    def _solve(self, low: int, high: int) -> None:
        if high - low <= self.least:
            return
        middle = (low + high) // 2
        self._solve(low, middle)
        for i in range(low, middle, BLOCK):
            for j in range(middle, high, BLOCK):
                self._push(i, min(i + BLOCK, middle), j, min(j + BLOCK, high))
        self._solve(middle, high)

    def _push(self, i: int, i_end: int, j: int, j_end: int) -> None:
        if j_end - 1 - i < self.least:
            return
        n = np.arange(j, j_end)[None, :] - np.arange(i, i_end)[:, None]
        size = np.maximum(n, 1).astype(self.kind)[None]
        total = self.sums[:, None, j:j_end] - self.sums[:, i:i_end, None]
        squares = self.squares[:, None, j:j_end] - self.squares[:, i:i_end, None]
        key = (_cost(size, _spread(size, total, squares), self.scale) << COUNT_BITS) + 1
        known = self.best[:, i:i_end, None] + (np.where(np.arange(i, i_end) > 0, self.penalty, 0) << COUNT_BITS)[None, :, None]
        key = np.where((n >= self.least)[None] & (self.best[:, i:i_end, None] < NEVER), key + known, NEVER)
        first = key.argmin(axis=1)
        found = np.take_along_axis(key, first[:, None, :], axis=1)[:, 0, :]
        here, begun = self.best[:, j:j_end], self.start[:, j:j_end]
        better = found < here
        here[better] = found[better]
        begun[better] = first[better] + i

    def cuts(self, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(series, first place, place after the last) of all segments, from the last one of each series backwards."""
        row, end = np.arange(len(lengths)), lengths.astype(np.int64)
        rows, firsts, ends = [], [], []
        while len(row):
            first = self.start[row, end].astype(np.int64)
            rows.append(row)
            firsts.append(first)
            ends.append(end)
            row, end = row[first > 0], first[first > 0]
        return np.concatenate(rows), np.concatenate(firsts), np.concatenate(ends)


def segments(series: list[np.ndarray], least: int = LEAST_DAYS, penalty: int = PENALTY, scale: int = SCALE) -> Iterator[tuple[np.ndarray, dict[str, np.ndarray]]]:
    """(index into `series`, columns of SEGMENT_SCHEMA with first_day from 0) for series of whole numbers, none empty."""
    if not series:
        return
    lengths = np.array([len(x) for x in series])
    middle = [int(sum(x.tolist())) // len(x) for x in series]
    # A segment's variance doesn't change when a constant is taken from the series; sums stay small.
    reach = [max(int(x.max()) - m, m - int(x.min())) for x, m in zip(series, middle)]
    kinds = [_kind(r, n) for r, n in zip(reach, lengths.tolist())]
    for kind in (np.float64, np.int64, object):
        mine = np.array(sorted((i for i in range(len(series)) if kinds[i] is kind), key=lambda i: lengths[i]), dtype=np.int64)
        at = 0
        while at < len(mine):
            shortest, side = lengths[mine[at]], CELLS // BLOCK**2
            part = mine[at : at + side]
            part = part[lengths[part] <= 2 * shortest + least]
            at += len(part)
            size = lengths[part]
            values = np.zeros((len(part), size.max()), dtype=kind if kind is object else np.int64)
            for row, i in enumerate(part.tolist()):
                values[row, : lengths[i]] = (series[i].astype(object) if kind is object else series[i]) - middle[i]
            held = _Series(values, kind, least, penalty, scale)
            row, first, end = held.cuts(size)
            order = np.lexsort((first, row))
            row, first, end = row[order], first[order], end[order]
            n = end - first
            exact = n.astype(kind)
            total = held.sums[row, end] - held.sums[row, first]
            spread = _spread(exact, total, held.squares[row, end] - held.squares[row, first])
            cost = _cost(exact, spread, scale)
            opens = np.r_[True, row[1:] != row[:-1]]
            begin = np.flatnonzero(opens)
            number = np.arange(len(row)) - np.repeat(begin, np.diff(np.r_[begin, len(row)])) + 1
            count = np.bincount(row, minlength=len(part))
            best = np.add.reduceat(cost, begin) + penalty * (count - 1)
            shift = np.array([middle[i] for i in part.tolist()], dtype=object)[row]
            yield part[row], {
                "segment_no": number.astype(np.int32),
                "first_day": first,
                "n_days": n,
                "total": (total.astype(np.int64) if kind is not object else total).astype(object) + shift * n,
                "spread": spread.astype(np.int64),
                "cost": cost,
                "n_segments": count[row],
                "best_cost": best[row],
            }


def _cut(least: int, penalty: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            days, sums = batch.column(1), batch.column(2)
            ends = np.cumsum(np.asarray(days.value_lengths()))
            day, total = np.asarray(days.flatten()).astype(np.int64), np.asarray(sums.flatten())
            begin = np.r_[0, ends[:-1]].astype(np.int64)
            first = day[begin] if len(day) else begin
            series = []
            for a, b, d in zip(begin.tolist(), ends.tolist(), first.tolist()):
                whole = np.zeros(day[b - 1] - d + 1, dtype=np.int64)
                whole[day[a:b] - d] = total[a:b]
                series.append(whole)
            for of, columns in segments(series, least, penalty, scale):
                columns["first_day"] = columns["first_day"] + first[of]
                fields = [pa.array(v, pa.int32() if k == "segment_no" else pa.int64()) for k, v in columns.items()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *fields], names=["key", *columns])

    return run


def change_points(rows: DataFrame, key: str | Column, at: str | Column, value: str | Column, least: int = LEAST_DAYS, penalty: int = PENALTY, scale: int = SCALE) -> DataFrame:
    """The columns `key` and SEGMENT_SCHEMA: daily sums of `value` by the day of `at`, cut for each key into segments of at
    least `least` days with the least cost. Days between without rows count 0."""
    taken = rows.select(F.col(key).alias("key") if isinstance(key, str) else key.alias("key"), F.unix_date(F.to_date(at)).alias("day"), (F.col(value) if isinstance(value, str) else value).cast("long").alias("value"))
    daily = taken.filter("day is not null and value is not null").groupBy("key", "day").agg(F.sum("value").alias("value"))
    pairs = F.array_sort(F.collect_list(F.struct("day", "value")))
    series = daily.groupBy("key").agg(pairs.alias("pairs")).select("key", F.col("pairs.day").alias("day"), F.col("pairs.value").alias("value"))
    kind = series.schema["key"].dataType.simpleString()
    return series.mapInArrow(tidy(_cut(least, penalty, scale)), f"key {kind}, {SEGMENT_SCHEMA}")


def op12_change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change_points(read_table(spark, sf_dir, "sale_lines"), "vendor_id", "shipped_at", "quantity").withColumnRenamed("key", "vendor_id")


#: The same search one day after another, with every start of each segment compared by (cost, segments, start).
OP12_SQL = """
WITH RECURSIVE daily AS (
  SELECT vendor_id, date_diff('day', DATE '1970-01-01', CAST(shipped_at AS DATE)) AS day, sum(quantity) AS x
  FROM sale_lines WHERE quantity IS NOT NULL AND shipped_at IS NOT NULL GROUP BY 1, 2
), span AS (
  SELECT vendor_id, min(day) AS first_day, unnest(range(min(day), max(day) + 1)) AS day FROM daily GROUP BY vendor_id
), summed AS (
  SELECT s.vendor_id, s.first_day, s.day, sum(coalesce(x, 0)::HUGEINT) OVER w AS s1, sum(coalesce(x, 0)::HUGEINT * coalesce(x, 0)::HUGEINT) OVER w AS s2
  FROM span s LEFT JOIN daily d ON d.vendor_id IS NOT DISTINCT FROM s.vendor_id AND d.day = s.day
  WINDOW w AS (PARTITION BY s.vendor_id ORDER BY s.day)
), held AS (
  SELECT vendor_id, first_day, count(*) AS n, list_prepend(0::HUGEINT, list(s1::HUGEINT ORDER BY day)) AS p, list_prepend(0::HUGEINT, list(s2::HUGEINT ORDER BY day)) AS q
  FROM summed GROUP BY vendor_id, first_day
), best AS (
  SELECT vendor_id, first_day, n, p, q, 0::BIGINT AS j, [{'c': 0::BIGINT, 'k': 0::BIGINT, 'i': 0::BIGINT}] AS f FROM held
  UNION ALL
  SELECT vendor_id, first_day, n, p, q, j + 1,
    list_append(f, list_min(list_transform(
      list_filter(range(0, j + 1), lambda i: (j + 1 - i >= 14 OR (i = 0 AND j + 1 = n)) AND f[i + 1] IS NOT NULL),
      lambda i: {'c': f[i + 1].c + CASE WHEN i > 0 THEN 40000 ELSE 0 END + (j + 1 - i) * CAST(floor(1000 * ln(CAST(1 + ((j + 1 - i) * (q[j + 2] - q[i + 1]) - (p[j + 2] - p[i + 1]) * (p[j + 2] - p[i + 1])) // ((j + 1 - i) * (j + 1 - i)) AS DOUBLE))) AS BIGINT),
            'k': f[i + 1].k + 1, 'i': i})))
  FROM best WHERE j < n
), cut AS (
  SELECT vendor_id, first_day, p, q, f, n AS e, f[n + 1].i AS a, f[n + 1].k AS no, f[n + 1].k AS n_segments, f[n + 1].c AS best_cost FROM best WHERE j = n
  UNION ALL
  SELECT vendor_id, first_day, p, q, f, a, f[a + 1].i, no - 1, n_segments, best_cost FROM cut WHERE a > 0
), measured AS (
  SELECT *, e - a AS n_days, p[e + 1] - p[a + 1] AS total, 1 + ((e - a) * (q[e + 1] - q[a + 1]) - (p[e + 1] - p[a + 1]) * (p[e + 1] - p[a + 1])) // ((e - a) * (e - a)) AS spread FROM cut
)
SELECT vendor_id, CAST(no AS INTEGER) AS segment_no, CAST(first_day + a AS BIGINT) AS first_day, CAST(n_days AS BIGINT) AS n_days, CAST(total AS BIGINT) AS total, CAST(spread AS BIGINT) AS spread,
  CAST(n_days * floor(1000 * ln(CAST(spread AS DOUBLE))) AS BIGINT) AS cost, CAST(n_segments AS BIGINT) AS n_segments, CAST(best_cost AS BIGINT) AS best_cost
FROM measured
"""
