"""Exact order statistics per group by distributed multi-select, and summaries that combine.

The values are laid out once: a group's rows lie together, sorted, in one task or, if it has more than `PART_ROWS`, in
as many as that takes. From then on no value is shuffled. All wanted ranks of all groups are looked for at once. Every
round is one scan: each batch counts its rows below, at and above the pivot of every live interval, and proposes the
median of its rows on either side. The counts tell on which side a wanted rank lies; the median of that side's
proposals, weighted by the rows behind them, becomes its next pivot. A pivot at least a quarter of the rows lie on
either side of rules out that many. What holds no wanted rank any more is left out of the next copy, which is written
whenever three quarters of its rows are ruled out. An interval of at most `FINISH` rows is settled by looking at its rows.

Only counts and pivots, a few numbers for each live interval, reach the driver and the workers: the groups are taken in
blocks of at most `BLOCK` wanted ranks, so that this is bounded whatever the number of groups.

A summary has the ranks of the percentiles and of a grid: `grid` even cells, and cells that narrow towards the maximum,
each at most 1/TAIL of what lies above its lower end. Merged over parts (days, partitions) the rank error at share p is
at most min(1/grid, (1 - p)/TAIL) + LAST of the merged rows, since it is at most that in each part, whatever share the
value has there.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quotemill.session import cut, stored

PERCENTILES = (0.5, 0.9, 0.95, 0.99)
GRID = 200
#: The cells of the tail are at most 1/TAIL of what lies above, down to the last one of a share LAST.
TAIL, LAST = 20, 1e-4
FINISH = 32
PART_ROWS = 1_000_000
BLOCK = 500_000


def shares(percentiles: Sequence[float], grid: int | None) -> list[float]:
    """The shares of the percentiles and, unless `grid` is None, of the even grid and of the tail, ascending."""
    if grid is None:
        return sorted({*percentiles})
    tail, above = [], TAIL / grid  # from here on the tail's cells are narrower than the even ones
    while above > LAST:
        tail.append(1 - above)
        above *= 1 - 1 / TAIL
    return sorted({*percentiles, *(i / grid for i in range(grid + 1)), *(t for t in tail if t > 0), 1 - LAST})


def _rank(p: Column | float, n: Column) -> Column:
    """The rank (from 1) of the value at share p of n."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(p * n - 1e-9).cast("long"))


class Intervals:
    """Live intervals, open on both sides, sorted by group and lower end, with the pivot to count at."""

    def __init__(self, g: np.ndarray, lo: np.ndarray, hi: np.ndarray, pivot: np.ndarray) -> None:
        self.g, self.lo, self.hi, self.pivot = g, lo, hi, pivot

    def places(self, batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Per group in a batch of sorted (`g`, `v`): its intervals, its values, and where each interval begins and ends among them."""
        gs, vs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edge = np.flatnonzero(np.r_[True, np.diff(gs) != 0, True])
        first, last = np.searchsorted(self.g, gs[edge[:-1]], "left"), np.searchsorted(self.g, gs[edge[:-1]], "right")
        for a, b, i, j in zip(edge[:-1], edge[1:], first, last):
            if i < j:
                v = vs[a:b]
                yield slice(i, j), v, np.searchsorted(v, self.lo[i:j], "right"), np.searchsorted(v, self.hi[i:j], "left")


def _columns(parts: list[tuple], names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], names.split())


def _counting(intervals: Callable[[], Intervals]) -> Callable:
    """Counts three ways and proposes local medians: a row per batch and interval that has rows in it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = intervals()
        for batch in batches:
            parts = []
            for at, v, a, b in own.places(batch):
                m, e = np.searchsorted(v, own.pivot[at], "left"), np.searchsorted(v, own.pivot[at], "right")
                m, e = np.clip(m, a, b), np.clip(e, a, b)
                some = np.flatnonzero(b > a)
                a, b, m, e = a[some], b[some], m[some], e[some]
                low, high = v[np.maximum(a, (a + m - 1) // 2)], v[np.minimum(b - 1, (e + b - 1) // 2)]
                parts.append((some + at.start, m - a, e - m, b - e, low, high))
            if parts:
                yield _columns(parts, "k below equal above low high")

    return scan


def _inside(intervals: Callable[[], Intervals], keyed: bool) -> Callable:
    """The rows in live intervals: (`g`, `v`), or (`k`, `v`) with the interval's number."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = intervals()
        for batch in batches:
            parts = []
            for at, v, a, b in own.places(batch):
                k = np.repeat(np.arange(at.start, at.stop), b - a)
                index = np.arange(len(k)) + np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a)
                parts.append((k if keyed else own.g[k], v[index]))
            if parts:
                yield _columns(parts, "k v" if keyed else "g v")

    return scan


def _laid_out(values: DataFrame, groups: DataFrame) -> DataFrame:
    """Each group's rows together and sorted; groups of more than PART_ROWS in several tasks."""
    large = groups.where(F.col("n") > PART_ROWS).select("g", F.ceil(F.col("n") / PART_ROWS).cast("long").alias("s"))
    salted = values.withColumn("i", F.monotonically_increasing_id()).join(large, "g", "left")
    salt = F.pmod("i", F.coalesce("s", F.lit(1)))
    return salted.select("g", "v", salt.alias("i")).repartition("g", "i").sortWithinPartitions("g", "v").select("g", "v")


def _settle(live: DataFrame, stored: int, g: np.ndarray, n: np.ndarray, parts: Sequence[float], finish: int, trace: list | None) -> DataFrame:
    """(`g`, `rank`, `value`) of the wanted ranks of some groups, whose number is bounded; `g` ascending, `n` their rows."""
    spark = live.sparkSession
    ranks = np.maximum(1, np.ceil(np.outer(n, parts) - 1e-9).astype(np.int64))
    new = np.diff(ranks, axis=1, prepend=0) != 0  # a rank that several shares have is looked for once
    k, want = np.nonzero(new)[0], ranks[new]
    r, kg = want.copy(), g[k]  # the rank within the interval k, and its group
    state = Intervals(g, np.full(len(g), -np.inf), np.full(len(g), np.inf), np.full(len(g), -np.inf))
    size = n.copy()
    found: list[pd.DataFrame] = []
    while (size > finish).any():
        sent = spark.sparkContext.broadcast((state.g, state.lo, state.hi, state.pivot))
        scanned = live.mapInArrow(_counting(lambda sent=sent: Intervals(*sent.value)), "k long, below long, equal long, above long, low double, high double")
        middle = lambda v, w: F.percentile(F.when(F.col(w) > 0, F.col(v)), F.lit(0.5), F.col(w))
        stats = scanned.groupBy("k").agg(F.sum("below").alias("below"), F.sum("equal").alias("equal"), F.sum("above").alias("above"), middle("low", "below").alias("low"), middle("high", "above").alias("high")).toArrow().to_pandas().sort_values("k")
        assert len(stats) == len(state.g)
        below, equal, above = (stats[c].to_numpy() for c in ("below", "equal", "above"))
        side = np.where(r <= below[k], 0, np.where(r <= below[k] + equal[k], 1, 2))
        hit = side == 1
        found.append(pd.DataFrame({"g": kg[hit], "rank": want[hit], "value": state.pivot[k[hit]]}))
        r = np.where(side == 2, r - below[k] - equal[k], r)[~hit]
        child, k = np.unique(2 * k[~hit] + side[~hit] // 2, return_inverse=True)  # in the order of group and lower end
        want, kg = want[~hit], kg[~hit]
        old, up = child // 2, child % 2 == 1
        pivot = np.where(up, stats["high"].to_numpy()[old], stats["low"].to_numpy()[old])
        size = np.where(up, above[old], below[old])
        state = Intervals(state.g[old], np.where(up, state.pivot[old], state.lo[old]), np.where(up, state.hi[old], state.pivot[old]), pivot)
        if trace is not None:
            trace.append((len(state.g), int(size.sum())))
        sent.unpersist()
        if 4 * size.sum() <= stored:
            sent = spark.sparkContext.broadcast((state.g, state.lo, state.hi, state.pivot))
            live, stored = cut(live.mapInArrow(_inside(lambda sent=sent: Intervals(*sent.value), False), "g long, v double")), int(size.sum())
    sent = spark.sparkContext.broadcast((state.g, state.lo, state.hi, state.pivot))
    rows = live.mapInArrow(_inside(lambda sent=sent: Intervals(*sent.value), True), "k long, v double")
    few = rows.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("vs"))  # at most `finish` each
    asked = spark.createDataFrame(pa.table({"g": kg, "rank": want, "k": k.astype(np.int64), "r": r.astype(np.int32)}))
    out = asked.join(few, "k").select("g", "rank", F.element_at("vs", F.col("r")).alias("value"))
    return out.unionByName(spark.createDataFrame(pa.Table.from_pandas(pd.concat(found), preserve_index=False))) if found else out


def select_ranks(values: DataFrame, parts: Sequence[float], groups: DataFrame | None = None, finish: int = FINISH, block: int = BLOCK, trace: list | None = None) -> DataFrame:
    """(`g`, `rank`, `value`): the values of the ranks max(1, ceil(p*n)) of every group, exactly; `values` are (`g` long, `v` double).

    `groups` (`g`, `n`) are the groups' sizes, if known. Null and NaN values must not be among them; infinite ones may
    not either. No values, no rows. `trace` gets (live intervals, rows in them) of every round.
    """
    values = values.select("g", "v")
    groups = cut(values.groupBy("g").agg(F.count("*").alias("n"))) if groups is None else groups.select("g", "n")
    live = cut(_laid_out(values, groups))
    number, all_rows = groups.agg(F.count("*"), F.sum("n")).first()
    out = None
    blocks = max(1, -(-number * len(parts) // block))
    for b in range(blocks):
        here = F.pmod(F.xxhash64("g"), F.lit(blocks)) == b
        own = groups.where(here).toArrow().to_pandas().sort_values("g")
        part = live if blocks == 1 else live.where(here)
        some = _settle(part, int(own["n"].sum()), own["g"].to_numpy(), own["n"].to_numpy(), parts, finish, trace)
        out = some if out is None else out.unionByName(some)
    return out


def request_times(timings: DataFrame, summaries: DataFrame) -> DataFrame:
    """(`pruning_mode`, `day`, `metric`, `v`) of every request, each `timing_id` once, as received last; rows without an id count each.

    Of rows received at the same time the greatest counts (by day, run, then times), and a null time of receipt is the
    earliest. Modes are compared without case, outer blanks and the kind of dash; a run without a mode or without a
    summary is `unknown`. Null, NaN, infinite, zero and negative times are no measurements; a null start has the day null.
    """
    spelled = F.regexp_replace(F.lower(F.trim("pruning_mode")), r"[\s-]+", "_")
    modes = summaries.groupBy("run_id").agg(F.max(F.when(spelled != "", spelled)).alias("pruning_mode"))
    once = timings.select("timing_id", "received_at", "run_id", F.to_date("started_at").alias("day"), F.col("timing.ttft_sec").alias("ttft_sec"), F.col("timing.total_sec").alias("total_sec"))
    fields = ("day", "run_id", "ttft_sec", "total_sec")
    unnamed = once.where("timing_id is null").select(*fields)
    latest = once.where("timing_id is not null").groupBy("timing_id").agg(F.max(F.struct("received_at", *fields)).alias("t"))
    once = latest.select(*[f"t.{c}" for c in fields]).unionByName(unnamed)
    both = once.join(modes, "run_id", "left").select(F.coalesce("pruning_mode", F.lit("unknown")).alias("pruning_mode"), "day", F.explode(F.create_map(F.lit("ttft_sec"), "ttft_sec", F.lit("total_sec"), "total_sec")).alias("metric", "v"))
    return both.where("v > 0 and not isnan(v) and v < double('infinity')")


def percentiles(timings: DataFrame, summaries: DataFrame, wanted: Sequence[float] = PERCENTILES, grid: int | None = GRID, by: Sequence[str] = ("pruning_mode", "day", "metric"), **kw) -> DataFrame:
    """(`pruning_mode`, `day`, `metric`, `n`, `p`, `value`): exact percentiles and the grid of each group; the value at p is the one of rank max(1, ceil(p*n)).

    Without a grid (None) it has the percentiles only. `by` may leave out some of the three key columns.
    """
    times = request_times(timings, summaries)
    values = stored(times.select(*by, F.xxhash64(*by).alias("g"), "v"))  # as columns, where the keys take next to no room
    groups = cut(values.groupBy("g", *by).agg(F.count("*").alias("n")))
    parts = shares(wanted, grid)
    found = select_ranks(values, parts, groups, **kw)
    asked = groups.select("g", *by, "n", F.explode(F.array(*map(F.lit, parts))).alias("p")).withColumn("rank", _rank(F.col("p"), F.col("n")))
    return asked.join(found, ["g", "rank"]).select(*by, "n", "p", "value")


def combine(summary: DataFrame, *by: str, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """Percentiles over merged groups from all values of their summaries, each of which must reach p = 1.

    A value stands for the rows of its part from the rank before on; what is no column of `by` tells the parts apart.
    """
    part = Window.partitionBy(*[c for c in summary.columns if c not in ("n", "p", "value")]).orderBy("p")
    ranked = summary.withColumn("r", _rank(F.col("p"), F.col("n")))
    cells = ranked.withColumn("w", F.col("r") - F.coalesce(F.lag("r").over(part), F.lit(0))).where("w > 0")
    w = Window.partitionBy(*by).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    run = cells.withColumn("upto", F.sum("w").over(w)).withColumn("all", F.sum("w").over(Window.partitionBy(*by)))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= _rank(p, F.col("all")), F.col("value"))).alias(f"p{round(p * 1000)}") for p in wanted])


def merged_error(timings: DataFrame, summaries: DataFrame, wanted: Sequence[float] = PERCENTILES) -> DataFrame:
    """(`pruning_mode`, `metric`, `p`, `n`, `within`): whether the percentile merged over all days is as near as promised, against the ranks its value has among all rows."""
    merged = combine(percentiles(timings, summaries, wanted), "pruning_mode", "metric")
    told = cut(merged.select("pruning_mode", "metric", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.col(f"p{round(p * 1000)}").alias("x")) for p in wanted])).alias("t")).select("pruning_mode", "metric", "t.*"))
    wide = told.groupBy("pruning_mode", "metric").agg(F.collect_list(F.struct("p", "x")).alias("told"))  # len(wanted) each
    both = request_times(timings, summaries).join(wide, ["pruning_mode", "metric"]).select("pruning_mode", "metric", "v", F.explode("told").alias("t"))
    ranks = both.groupBy("pruning_mode", "metric", "t.p").agg(F.count("*").alias("n"), F.count_if(F.col("v") < F.col("t.x")).alias("below"), F.count_if(F.col("v") <= F.col("t.x")).alias("upto"))
    bound = (F.least(F.lit(1 / GRID), (1 - F.col("p")) / TAIL) + LAST) * F.col("n") + 1
    rank = _rank(F.col("p"), F.col("n"))
    return ranks.select("pruning_mode", "metric", "p", "n", ((F.col("below") + 1 - rank <= bound) & (rank - F.col("upto") <= bound)).alias("within"))
