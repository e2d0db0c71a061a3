"""Box-shaped period search, its period grid, peaks and pooled periodograms.

A search is parted into (source, block of periods) tasks: one a source where sources outnumber the cores, more where
they don't. A period's result doesn't depend on its block, so any number of tasks gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspark.config import SearchConfig
from foldspark.functions import is_finite

PERIODOGRAM = "period double, power double, duration double, transit_time double, depth double, depth_err double, depth_snr double, log_likelihood double"
#: Samples or phase bins of neighbouring periods that are searched in one array.
CELLS = 32_768


def grid_size(baseline: Column, lo: Column, hi: Column, min_duration: float, oversample: float) -> Column:
    """Periods that keep the drift over the baseline under min_duration / oversample, evenly in log period."""
    step = min_duration / (oversample * baseline)
    return F.ceil(F.log(hi / lo) / step).cast("long") + 1


def grid_period(index: Column, n: Column, lo: Column, hi: Column) -> Column:
    return F.exp(F.log(lo) + index * ((F.log(hi) - F.log(lo)) / F.greatest(n - 1, F.lit(1))))


def period_grid(sources: DataFrame, lo: float, hi: float, min_duration: float, oversample: float, baseline: str = "baseline") -> DataFrame:
    """(sources' columns, k, period): each source's grid, exploded."""
    if not 0 < lo < hi:
        raise ValueError("a period grid needs 0 < lo < hi")
    low, high = F.lit(float(lo)), F.lit(float(hi))
    sized = sources.withColumn("_n", grid_size(F.col(baseline), low, high, min_duration, oversample))
    return sized.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).withColumn("period", grid_period(F.col("k"), F.col("_n"), low, high)).drop("_n")


def box_power(t: np.ndarray, y: np.ndarray, dy: np.ndarray, periods: np.ndarray, durations: np.ndarray, objective: str, phase_oversample: int) -> dict[str, np.ndarray]:
    """The best box of each period, after Kovacs et al. (2002): the weighted mean inside it against that outside.

    Samples are summed into phase bins of a fraction of the least duration; differences of the running sums are the
    boxes at all phases. Neighbouring periods are rows of one array, as many as ``CELLS`` allows, which changes no
    period's result.
    """
    y = y - np.median(y)
    weight = 1.0 / dy**2
    start = float(t.min())
    since = t - start
    wy = weight * y
    all_w, all_wy = float(weight.sum()), float(wy.sum())
    step = float(durations.min()) / phase_oversample
    lasting = np.asarray(durations, dtype=float)
    lengths = np.array([max(1, int(round(d / step))) for d in lasting])
    longest = int(lengths.max())
    out = {k.split()[0]: np.full(len(periods), np.nan) for k in PERIODOGRAM.split(", ")}
    out["period"] = periods
    sizes = np.ceil(periods / step).astype(np.int64)
    sums_of = _RunningSums(since, (weight, wy), step, longest)
    begin = 0
    while begin < len(periods):
        widths = np.maximum.accumulate(sizes[begin : begin + max(1, CELLS // len(t))]) + longest + 1
        cells = np.arange(1, len(widths) + 1) * np.maximum(widths, len(t))
        end = begin + max(1, int(np.searchsorted(cells, CELLS, side="right")))
        sums = sums_of(periods[begin:end], sizes[begin:end])
        starts = sums.shape[2] - 1 - longest
        every, within = np.arange(end - begin), np.arange(starts) < sizes[begin:end, None]
        best = np.full(end - begin, -np.inf)
        first, which = np.zeros((2, end - begin), dtype=np.int64)
        for number, span in enumerate(lengths):
            inside_w = sums[0, :, span : span + starts] - sums[0, :, :starts]
            inside_y = sums[1, :, span : span + starts] - sums[1, :, :starts]
            outside_w = all_w - inside_w
            with np.errstate(divide="ignore", invalid="ignore"):
                depth = all_wy - inside_y
                depth /= outside_w
                inside_y /= inside_w
                depth -= inside_y
                goal = 0.5 * inside_w * depth**2 if objective == "likelihood" else depth / np.sqrt(1.0 / inside_w + 1.0 / outside_w)
            allowed = (inside_w > 1e-12 * all_w) & (outside_w > 1e-12 * all_w) & (depth >= 0) & within
            np.copyto(goal, -np.inf, where=~allowed)
            k = goal.argmax(axis=1)
            highest = goal[every, k]
            better = highest > best
            for kept, values in ((best, highest), (first, k), (which, number)):
                np.copyto(kept, values, where=better)
        some = np.flatnonzero(best > -np.inf)
        k, duration = first[some], lasting[which[some]]
        w, inside_y = sums[:, some, k + lengths[which[some]]] - sums[:, some, k]
        outside = all_w - w
        d = (all_wy - inside_y) / outside - inside_y / w
        # Powers of single numbers, as their last bit may differ from that of a whole array's.
        error = np.array([e**0.5 for e in 1.0 / w + 1.0 / outside])
        at = begin + some
        out["power"][at], out["duration"][at] = best[some], duration
        out["transit_time"][at] = start + (k * step + 0.5 * duration) % periods[at]
        out["depth"][at], out["depth_err"][at], out["depth_snr"][at] = d, error, d / error
        out["log_likelihood"][at] = 0.5 * w * np.array([v**2 for v in d])
        begin = end
    return out


class _RunningSums:
    """Running sums of samples over the phase bins of neighbouring periods; the arrays by sample serve every call."""

    def __init__(self, since: np.ndarray, values: tuple[np.ndarray, ...], step: float, longest: int):
        rows = max(1, CELLS // len(since))
        self.since, self.step, self.longest = since, step, longest
        self.values = [np.tile(v, rows) for v in values]
        self.phase, self.whole, self.place = (np.empty((rows, len(since)), dtype=d) for d in (float, float, np.int64))

    def __call__(self, periods: np.ndarray, n: np.ndarray) -> np.ndarray:
        """(value, period, bin): the sums up to each bin of a period's ``n`` and then of its first ``longest`` again.

        What follows in the rows of shorter periods has no meaning.
        """
        rows, most = len(periods), int(n.max())
        phase, whole, place = self.phase[:rows], self.whole[:rows], self.place[:rows]
        np.multiply(self.since, (1.0 / periods)[:, None], out=phase)
        np.floor(phase, out=whole)
        phase -= whole
        phase *= (periods / self.step)[:, None]
        np.minimum(phase, (n - 1)[:, None], out=phase)
        # The conversion cuts off the fraction.
        np.copyto(place, phase, casting="unsafe")
        if rows > 1:
            place += most * np.arange(rows)[:, None]
        sums = np.zeros((len(self.values), rows, most + self.longest + 1))
        again = np.arange(self.longest)
        each, after, first = np.arange(rows)[:, None], n[:, None] + 1 + again, again % n[:, None] + 1
        for made, values in zip(sums, self.values):
            made[:, 1 : most + 1] = np.bincount(place.ravel(), weights=values[: place.size], minlength=rows * most).reshape(rows, most)
            made[each, after] = made[each, first]
            np.cumsum(made[:, 1:], axis=1, out=made[:, 1:])
        return sums


def search_inputs(curve: DataFrame, keys: list[str], config: SearchConfig, value: str = "flux", error: str = "flux_err") -> DataFrame:
    """One row per key: its samples as arrays t, y, e in time order, its baseline, grid and status.

    A key whose samples can't be searched keeps its row with a status that says why.
    """
    good = curve.filter(is_finite("time") & is_finite(value) & is_finite(error))
    one = F.struct(F.col("time").cast("double").alias("t"), F.col(value).cast("double").alias("y"), F.col(error).cast("double").alias("e"))
    rows = good.groupBy(*keys).agg(
        F.array_sort(F.collect_list(one)).alias("samples"), F.count("*").cast("int").alias("n_points"), (F.max("time") - F.min("time")).alias("baseline")
    )
    shortest = min(config.durations_hours) / 24.0
    rows = rows.withColumn("hi", F.least(F.lit(float(config.max_period_days)), F.col("baseline") / (config.min_transits - 1)))
    lo = F.lit(float(config.min_period_days))
    rows = rows.withColumn("n_periods", F.when(F.col("hi") > lo, grid_size(F.col("baseline"), lo, F.col("hi"), shortest, config.oversample)))
    status = (
        F.when(F.col("n_points") < 100, "too_few_samples").when(F.col("n_periods").isNull(), "baseline_too_short")
        .when(F.col("n_periods") > config.max_grid_size, "grid_too_large").otherwise("ok")
    )
    part = lambda name: F.transform("samples", lambda s: s[name])
    return rows.withColumn("status", status).withColumns({c: part(c) for c in ("t", "y", "e")}).drop("samples")


def periodogram(inputs: DataFrame, keys: list[str], config: SearchConfig) -> DataFrame:
    """(keys, k, PERIODOGRAM) of every period of every key whose status is ok.

    A key's samples are shuffled once for each of its blocks of periods, which are as many as the cores need to be busy:
    one where keys outnumber the tasks. ``config.chunk`` is the least number of periods worth a block.
    """
    ready = inputs.filter("status = 'ok'")
    # The samples' arrays aren't made for this count, as it doesn't need them.
    spark = inputs.sparkSession
    tasks = 4 * spark.sparkContext.defaultParallelism
    wanted = -(-tasks // max(1, ready.select(*keys).count()))
    blocks = F.least(F.lit(wanted), F.ceil(F.col("n_periods") / config.chunk)).cast("int")
    chunks = ready.withColumn("blocks", blocks).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    durations = np.sort(np.array(config.durations_hours)) / 24.0
    spread = chunks.select(*keys, "t", "y", "e", "hi", "n_periods", "blocks", "block")
    # With a number, as few small rows would be merged into one task.
    spread = spread.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys, "block")
    names = [c.split()[0] for c in PERIODOGRAM.split(", ")]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(len(batch)):
                row = batch.iloc[at]
                t, y, e = (np.asarray(row[f], dtype=float) for f in ("t", "y", "e"))
                ends = row["n_periods"] * np.array([row["block"], row["block"] + 1]) // row["blocks"]
                lo, hi = math.log(config.min_period_days), math.log(row["hi"])
                for begin in range(int(ends[0]), int(ends[1]), 4096):
                    k = np.arange(begin, min(int(ends[1]), begin + 4096))
                    periods = np.exp(lo + k * ((hi - lo) / max(1, row["n_periods"] - 1)))
                    found = box_power(t, y, e, periods, durations, config.objective, config.phase_oversample)
                    yield pd.DataFrame({**{c: row[c] for c in keys}, "k": k, **{c: found[c] for c in names}})

    schema = ", ".join(f"`{c}` {t}" for c, t in inputs.select(*keys).dtypes)
    return spread.mapInPandas(search, f"{schema}, k long, {PERIODOGRAM}")


def best_peaks(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, the strongest period's columns, n_periods, sde): of equal powers the first; ``sde`` is (max - mean) / std."""
    columns = [c for c in found.columns if c not in (*keys, "k")]
    best = F.max_by(F.struct(*columns), F.struct("power", -F.col("k")))
    made = found.filter(F.col("power").isNotNull() & ~F.isnan("power")).groupBy(*keys).agg(
        best.alias("_b"), F.count("*").alias("n_periods"), F.avg("power").alias("_mean"), F.stddev_pop("power").alias("_std"),
        F.min("period").alias("min_period_days"), F.max("period").alias("max_period_days"),
    )
    return made.select(*keys, "_b.*", "n_periods", "min_period_days", "max_period_days", F.when(F.col("_std") > 0, (F.col("_b.power") - F.col("_mean")) / F.col("_std")).alias("sde"))


def top_peaks(found: DataFrame, keys: list[str], k: int = 5, apart: float = 0.01) -> DataFrame:
    """(keys, top_peaks): the strongest peaks whose periods differ by more than ``apart`` from every stronger one taken.

    The choice is greedy, so a key's powers are gathered and sorted; ``max_grid_size`` bounds them.
    """
    rows = found.filter(F.col("power").isNotNull() & ~F.isnan("power")).select(*keys, "period", "power")
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("power", "period")), asc=False).alias("_all"))
    near = lambda p, taken: F.exists(taken, lambda q: F.abs(p["period"] - q["period"]) / q["period"] <= apart)
    empty = F.array().cast("array<struct<power:double,period:double>>")
    greedy = F.aggregate("_all", empty, lambda taken, p: F.when((F.size(taken) >= k) | near(p, taken), taken).otherwise(F.array_append(taken, p)))
    return packed.select(*keys, F.transform(greedy, lambda q: F.struct(q["period"].alias("period_days"), q["power"].alias("power"))).alias("top_peaks"))


def pool_periodogram(found: DataFrame, keys: list[str], max_points: int = 2000, order: str = "k") -> DataFrame:
    """The strongest period of each of ``max_points`` equal runs, so peaks stay; a short periodogram stays whole.

    ``order`` numbers a key's periods from 0.
    """
    sizes = found.groupBy(*keys).agg((F.max(order) + 1).alias("_n"))
    placed = found.join(sizes, keys)
    # Run r holds the numbers from floor(n r / m) on, so r is the last one whose start isn't beyond the number.
    run = F.floor(((F.col(order) + 1) * max_points - 1) / F.col("_n"))
    placed = placed.withColumn("_run", F.when(F.col("_n") <= max_points, F.col(order)).otherwise(run))
    best = F.max_by(F.struct("period", "power"), F.struct(F.coalesce(F.nanvl("power", F.lit(float("-inf"))), F.lit(float("-inf"))), -F.col(order)))
    return placed.groupBy(*keys, F.col("_run").cast("long").alias("run")).agg(best.alias("_b")).select(*keys, "run", "_b.*")


def box_stats(curve: DataFrame, best: DataFrame, keys: list[str], value: str = "flux", error: str = "flux_err") -> DataFrame:
    """For each key's best box: depth of odd and even transits with errors, the gain of a sine over the box, transits with data.

    ``best`` has period, duration (days), transit_time. Weighted sums of the samples, so one aggregation.
    """
    rows = curve.filter(is_finite("time") & is_finite(value) & is_finite(error)).join(best.select(*keys, "period", "duration", "transit_time"), keys)
    middle = rows.withColumn("_y", F.col(value) - F.median(value).over(Window.partitionBy(*keys))).withColumn("_w", 1.0 / F.col(error) ** 2)
    number = F.rint((F.col("time") - F.col("transit_time")) / F.col("period"))
    away = F.col("time") - F.col("transit_time") - number * F.col("period")
    rows = middle.withColumn("_number", number).withColumn("_in", F.abs(away) < 0.5 * F.col("duration")).withColumn("_odd", F.pmod(number, F.lit(2.0)) == 1.0)
    phase = 2 * math.pi * F.pmod(F.col("time") - F.col("transit_time"), F.col("period")) / F.col("period")
    rows = rows.withColumn("_c", F.cos(phase)).withColumn("_s", F.sin(phase))

    def mean_of(which: Column) -> tuple[Column, Column]:
        weight = F.sum(F.when(which, F.col("_w")))
        return F.sum(F.when(which, F.col("_w") * F.col("_y"))) / weight, 1.0 / weight

    out_mean, out_var = mean_of(~F.col("_in"))
    odd_mean, odd_var = mean_of(F.col("_in") & F.col("_odd"))
    even_mean, even_var = mean_of(F.col("_in") & ~F.col("_odd"))
    in_mean, _ = mean_of(F.col("_in"))
    moment = lambda *names: F.sum(F.reduce(F.array(*(F.col(n) for n in names)), F.col("_w"), lambda a, v: a * v))
    agg = rows.groupBy(*keys).agg(
        (out_mean - odd_mean).alias("depth_odd"), F.sqrt(out_var + odd_var).alias("depth_odd_err"), (out_mean - even_mean).alias("depth_even"), F.sqrt(out_var + even_var).alias("depth_even_err"),
        F.count_distinct(F.when(F.col("_in"), F.col("_number"))).alias("n_transits_with_data"),
        F.sum("_w").alias("w"), moment("_c").alias("c"), moment("_s").alias("s"), moment("_c", "_c").alias("cc"), moment("_s", "_s").alias("ss"), moment("_c", "_s").alias("cs"),
        moment("_y").alias("y"), moment("_y", "_c").alias("yc"), moment("_y", "_s").alias("ys"), moment("_y", "_y").alias("yy"),
        out_mean.alias("_out"), in_mean.alias("_inn"), F.sum(F.when(F.col("_in"), F.col("_w"))).alias("_wi"),
    )
    # The best level, cosine and sine solve a 3 x 3 system, here by Cramer's rule; chi-squared falls by b . solution.
    m = [[F.col("w"), F.col("c"), F.col("s")], [F.col("c"), F.col("cc"), F.col("cs")], [F.col("s"), F.col("cs"), F.col("ss")]]
    b = [F.col("y"), F.col("yc"), F.col("ys")]
    det = lambda q: q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])
    swap = lambda j: [[b[r] if c == j else m[r][c] for c in range(3)] for r in range(3)]
    fall = sum((F.try_divide(det(swap(j)) * b[j], det(m)) for j in range(1, 3)), F.try_divide(det(swap(0)) * b[0], det(m)))
    sine = -0.5 * (F.col("yy") - fall)
    outside_w = F.col("w") - F.col("_wi")
    box = -0.5 * (F.col("yy") - outside_w * F.col("_out") ** 2 - F.col("_wi") * F.col("_inn") ** 2)
    return agg.select(*keys, "depth_odd", "depth_odd_err", "depth_even", "depth_even_err", (sine - box).alias("harmonic_delta_log_likelihood"), "n_transits_with_data")
