"""Playback events: heartbeats, monotonic time stamps and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marquee.operators.ranking import first_value, placed, running_max
from marquee.sources.scratch import scratch_path

#: Seconds of movement between two reports, and the place before the first.
HEARTBEAT, BEFORE = 10.0, -100.0


#: Rows of a key that one task folds at once.
SLICE = 4096


def first_far(values, at: int, last: float, step: float) -> int:
    """The first place from `at` on whose value is `step` or more away from `last`; the length if there is none. Looks at ever longer parts."""
    import numpy as np

    n, width = len(values), 16
    while at < n:
        far = np.abs(values[at : at + width] - last) >= step
        if far.any():
            return at + int(far.argmax())
        at, width = at + width, width * 4
    return n


def slice_effect(values, step: float):
    """What a slice of ordered values makes of any last report L before it: bounds, exits and counts.

    The first report of the slice is the first value that is at least L + step or at most L - step, so as L grows it changes only where a value is the highest or the lowest
    so far. Between two neighbouring bounds all L have the same first report, and with it the same last one (exit) and number of reports; where no value is far
    enough, exit is null and L stays. They are few where values go up and down, and at most four a row.
    """
    import numpy as np

    high, low = np.maximum.accumulate(values), np.minimum.accumulate(values)
    records = np.unique(np.concatenate([high, low]))
    bounds = np.unique(np.concatenate([records - step, records + step]))
    known: dict[int, tuple[float, int]] = {}

    def after(at: int) -> tuple[float, int]:
        """Last report and number of reports if the value at `at` is reported."""
        chain = []
        while at < len(values) and at not in known:
            chain.append(at)
            at = first_far(values, at + 1, values[at], step)
        last, n = known[at] if at < len(values) else (None, 0)
        for k in reversed(chain):
            last, n = (values[k] if last is None else last), n + 1
            known[k] = (last, n)
        return known[chain[0]] if chain else (last, n)

    if not len(bounds):
        return bounds, [], []
    # one L inside each interval and each bound itself: what a comparison says may differ at the bound, so both are tried
    points = np.empty(2 * len(bounds) + 1)
    points[1::2], points[2:-1:2], points[0], points[-1] = bounds, (bounds[:-1] + bounds[1:]) / 2, bounds[0] - 1, bounds[-1] + 1
    # rounding keeps the order of differences, so high and low tell whether any value so far is far enough: halve to the first place
    lo, hi = np.zeros(len(points), np.int64), np.full(len(points), len(values))
    while (lo < hi).any():
        mid = np.minimum((lo + hi) // 2, len(values) - 1)
        far = (high[mid] - points >= step) | (points - low[mid] >= step)
        lo, hi = np.where((lo < hi) & ~far, mid + 1, lo), np.where((lo < hi) & far, mid, hi)
    effects = [after(int(at)) for at in lo]
    # a bound goes where nothing changes at it
    kept = [k for k in range(len(bounds)) if not effects[2 * k] == effects[2 * k + 1] == effects[2 * k + 2]]
    chosen = [effects[0], *[e for k in kept for e in effects[2 * k + 1 : 2 * k + 3]]]
    return bounds[kept], [e[0] for e in chosen], [e[1] for e in chosen]


def heartbeats(events: DataFrame, keys: list[str], order: list[str], value: str, step: float = HEARTBEAT) -> DataFrame:
    """keys, n and reported: the ordered values of each key that are at least `step` away from the one reported before, numbered from 1. Nulls are no values.

    A key of any size is cut into slices of SLICE rows. Each slice is summed up by itself as a function of the report before it (slice_effect); a key's
    functions, a few numbers for each slice, are applied in their order; then each slice, with the report before it now known, gives its own reports.
    """
    import pyarrow as pa

    kinds = ", ".join(f"`{k}` {events.schema[k].dataType.simpleString()}" for k in keys)
    valued = events.select(*keys, *order, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    numbered = placed(valued, keys, [F.col(c) for c in [*order, "_v"]], name="_place", first=0)
    path = scratch_path(events.sparkSession, "slices")
    held = numbered.groupBy(*keys, F.floor(F.col("_place") / SLICE).cast("long").alias("_slice")).agg(F.array_sort(F.collect_list(F.struct("_place", "_v"))).alias("_rows"))
    held.select(*keys, "_slice", F.transform("_rows", lambda x: x["_v"]).alias("_values")).write.parquet(path)
    slices = events.sparkSession.read.parquet(path)

    def effects(batches):
        for batch in batches:
            found = [slice_effect(v.values.to_numpy(zero_copy_only=False), step) for v in batch.column("_values")]
            columns = [pa.array([f[i] for f in found], pa.list_(kind)) for i, kind in enumerate((pa.float64(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("_slice"), *columns], names=[*keys, "_slice", "_bounds", "_exits", "_counts"])

    def entries(batches):
        held, last, n = None, BEFORE, 0
        for batch in batches:
            before, base = [], []
            for i, key in enumerate(zip(*(batch.column(k).to_pylist() for k in keys))):
                if key != held:
                    held, last, n = key, BEFORE, 0
                before.append(last)
                base.append(n)
                bounds = batch.column("_bounds")[i].values.to_numpy(zero_copy_only=False)
                at = int(bounds.searchsorted(last))
                at = 2 * at + 1 if at < len(bounds) and bounds[at] == last else 2 * at
                exit_ = batch.column("_exits")[i][at].as_py()
                last, n = last if exit_ is None else exit_, n + batch.column("_counts")[i][at].as_py()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], batch.column("_slice"), pa.array(before, pa.float64()), pa.array(base, pa.int64())], names=[*keys, "_slice", "_last", "_n"])

    def reports(batches):
        for batch in batches:
            places, numbers, values = [], [], []
            for i, (v, last, n) in enumerate(zip(batch.column("_values"), batch.column("_last").to_pylist(), batch.column("_n").to_pylist())):
                own = v.values.to_numpy(zero_copy_only=False)
                at = first_far(own, 0, last, step)
                while at < len(own):
                    last, n = float(own[at]), n + 1
                    places.append(i)
                    numbers.append(n)
                    values.append(last)
                    at = first_far(own, at + 1, last, step)
            chosen = batch.select(keys).take(pa.array(places, pa.int64()))
            yield pa.RecordBatch.from_arrays([*chosen.columns, pa.array(numbers, pa.int64()), pa.array(values, pa.float64())], names=[*keys, "n", "reported"])

    effect = slices.mapInArrow(effects, f"{kinds}, _slice long, _bounds array<double>, _exits array<double>, _counts array<long>")
    entry = effect.repartition(*keys).sortWithinPartitions(*keys, "_slice").mapInArrow(entries, f"{kinds}, _slice long, _last double, _n long")
    same = F.col("s._slice") == F.col("e._slice")
    for k in keys:
        same = same & F.col(f"s.{k}").eqNullSafe(F.col(f"e.{k}"))
    joined = slices.alias("s").join(entry.alias("e"), same).select(*[f"s.{k}" for k in keys], "s._values", "e._last", "e._n")
    return joined.mapInArrow(reports, f"{kinds}, n long, reported double")


def monotonic(packets: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Strictly increasing time stamps y[n] = max(x[n], y[n-1] + 1) = n + running maximum of (x - n), taken in two levels: inside runs of rows, and over the runs before."""
    found = running_max(packets, [key], [F.col(order).asc_nulls_first()], F.col(value) - F.col(order), "_most")
    return found.withColumn("y", F.col(order) + F.col("_most")).drop("_most")


def zero_based(packets: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Time stamps from the first packet on."""
    found = first_value(packets, [key], [F.col(order).asc_nulls_first()], F.col(value), "_first")
    return found.withColumn("y", F.col(value) - F.col("_first")).drop("_first")


def bar(pct: Column) -> Column:
    """What a progress bar shows, to one decimal, halves up; null outside 1 to 95."""
    return F.when((pct >= 1) & (pct < 95), F.floor(pct * 10 + 0.5) / 10)
