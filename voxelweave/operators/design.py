"""Design matrices of measured runs: sparse convolved regressors, nuisance terms, targets.

Scans lie on a regular grid, so the scans a sentence or event reaches follow from arithmetic: each row
explodes to its own scans and no range join is needed. Convolution of a boxcar with the kernel is the
difference of two kernel prefix sums; single samples weigh in with the kernel value itself.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from voxelweave.functions.vector import lane_sums, lane_values, lanes
from voxelweave.session import cut


def glover_kernel(fine_hz: float, seconds: float = 32.0) -> list[float]:
    """Published double-gamma haemodynamic response, sampled at ``fine_hz`` and scaled to sum 1."""
    # Peak 6 s, undershoot 12 s, dispersions 0.9, ratio 0.35.
    peak, under, dispersion, ratio = 6.0, 12.0, 0.9, 0.35
    dt = 1.0 / fine_hz
    times = np.linspace(0.0, seconds, int(np.rint(seconds / dt)))

    def gamma_density(shape: float) -> np.ndarray:
        x = (times - dt) / dispersion
        inside = x > 0
        out = np.zeros_like(x)
        out[inside] = np.exp((shape - 1) * np.log(x[inside]) - x[inside] - math.lgamma(shape)) / dispersion
        return out

    curve = gamma_density(peak / dispersion) - ratio * gamma_density(under / dispersion)
    return [float(v) for v in curve / curve.sum()]


@dataclass(frozen=True)
class ScanClock:
    """Sampling of a study: seconds per scan, fine grid rate and convolution kernel."""

    tr: float
    fine_hz: float
    kernel: tuple[float, ...]

    @property
    def prefix(self) -> list[float]:
        return [float(v) for v in np.cumsum(self.kernel)]

    @property
    def reach(self) -> int:
        return len(self.kernel)


def grid_length(n_scans: Column, clock: ScanClock) -> Column:
    return F.ceil(n_scans * F.lit(clock.tr) * F.lit(clock.fine_hz)).cast("bigint")


def sample_index(scan: Column, n_scans: Column, clock: ScanClock) -> Column:
    """Fine-grid position of a scan, half-to-even rounding, clipped to the convolved length."""
    raw = F.rint(scan * F.lit(clock.tr) * F.lit(clock.fine_hz)).cast("bigint")
    return F.greatest(F.lit(0), F.least(raw, grid_length(n_scans, clock) + F.lit(clock.reach - 2)))


def _scans_reached(first: Column, last: Column, n_scans: Column, clock: ScanClock) -> Column:
    """Scans whose sample may fall in [first, last] fine steps, one scan of slack on both sides."""
    step = F.lit(clock.tr * clock.fine_hz)
    low = F.greatest(F.lit(0), F.floor(first / step) - 1).cast("int")
    high = F.least(n_scans - 1, F.ceil(last / step) + 1).cast("int")
    return F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("scan")


def _lookup(values: Sequence[float]) -> Column:
    """A constant array as one foldable expression; hundreds of literals would slow down analysis."""
    return F.from_json(F.lit(json.dumps([float(v) for v in values])), "array<double>")


def sentence_basis(timing: DataFrame, scans: DataFrame, clock: ScanClock) -> DataFrame:
    """Weight of every sentence in every scan it reaches: (language, canonical_run, scan, triplet_row_index, weight).

    ``scans`` holds n_scans per (language, canonical_run), one row per run.
    """
    hz = F.lit(clock.fine_hz)
    grid = grid_length(F.col("n_scans"), clock)
    on = F.greatest(F.lit(0), F.floor(F.col("onset_sec") * hz)).cast("bigint")
    off = F.greatest(on + 1, F.ceil(F.col("offset_sec") * hz).cast("bigint"))
    placed = (
        timing.join(scans, ["language", "canonical_run"])
        .withColumn("_grid", grid)
        .withColumn("_on", on)
        .withColumn("_off", F.least(off, F.col("_grid")))
        .where("_on < _off")
    )
    rows = placed.select(
        "language", "canonical_run", "triplet_row_index", "_on", "_off", "n_scans",
        _scans_reached(F.col("_on"), F.col("_off") + clock.reach, F.col("n_scans"), clock),
    ).withColumn("_s", sample_index(F.col("scan"), F.col("n_scans"), clock))
    table = _lookup(clock.prefix)

    def running(x: Column) -> Column:
        return F.when(x < 0, F.lit(0.0)).otherwise(F.element_at(table, F.least(x, F.lit(clock.reach - 1)).cast("int") + 1))

    weight = running(F.col("_s") - F.col("_on")) - running(F.col("_s") - F.col("_off"))
    inside = (F.col("_s") >= F.col("_on")) & (F.col("_s") < F.col("_off") + clock.reach - 1)
    return rows.where(inside).select("language", "canonical_run", "scan", "triplet_row_index", weight.alias("weight"))


def impulses(events: DataFrame, scans: DataFrame, clock: ScanClock) -> DataFrame:
    """Counts on the fine grid at the rounded onset; events at one step add up."""
    grid = grid_length(F.col("n_scans"), clock)
    step = F.greatest(F.lit(0), F.least(F.rint(F.col("onset_sec") * F.lit(clock.fine_hz)).cast("bigint"), grid - 1))
    return (
        events.join(scans, ["language", "canonical_run"])
        .groupBy("language", "canonical_run", step.alias("fine_index"))
        .agg(F.count(F.lit(1)).cast("double").alias("value"))
    )


def boxcars(events: DataFrame, scans: DataFrame, clock: ScanClock) -> DataFrame:
    """Ones wherever any interval [onset, onset + duration) lies; overlaps stay at one."""
    hz = F.lit(clock.fine_hz)
    grid = grid_length(F.col("n_scans"), clock)
    start = F.greatest(F.lit(0), F.least(F.floor(F.col("onset_sec") * hz).cast("bigint"), grid - 1))
    stop = F.greatest(start + 1, F.least(F.ceil((F.col("onset_sec") + F.col("duration_sec")) * hz).cast("bigint"), grid))
    steps = F.explode(F.sequence(start, stop - 1)).alias("fine_index")
    return (
        events.join(scans, ["language", "canonical_run"])
        .select("language", "canonical_run", steps)
        .distinct()
        .withColumn("value", F.lit(1.0))
    )


def interpolated(samples: DataFrame, scans: DataFrame, clock: ScanClock, bin_sec: float = 64.0) -> DataFrame:
    """Linear interpolation of (time_sec, value) samples on the fine grid, 0 outside the sampled span.

    The next sample is found inside time bins; the last sample of a bin connects to the head of the next
    filled bin, so windows stay as small as a bin.
    """
    keys = ["language", "canonical_run"]
    binned = samples.select(*keys, "time_sec", "value", F.floor(F.col("time_sec") / F.lit(bin_sec)).alias("_bin"))
    heads = binned.groupBy(*keys, "_bin").agg(F.min(F.struct("time_sec", "value")).alias("_head"))
    heads = heads.withColumn("_next_head", F.lead("_head").over(Window.partitionBy(*keys).orderBy("_bin"))).drop("_head")
    inside = Window.partitionBy(*keys, "_bin").orderBy("time_sec", "value")
    linked = (
        binned.withColumn("_lead", F.lead(F.struct("time_sec", "value")).over(inside))
        .join(heads, [*keys, "_bin"])
        .withColumn("_next", F.coalesce("_lead", "_next_head"))
        .join(scans, keys)
    )
    hz = F.lit(clock.fine_hz)
    first = F.greatest(F.lit(0), F.ceil(F.col("time_sec") * hz)).cast("bigint")
    # The bracket is half-open; the very last sample only reaches a grid point it coincides with.
    last = F.when(F.col("_next").isNull(), F.floor(F.col("time_sec") * hz)).otherwise(F.ceil(F.col("_next.time_sec") * hz) - 1)
    last = F.least(last.cast("bigint"), grid_length(F.col("n_scans"), clock) - 1)
    steps = F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))).alias("fine_index")
    x = F.col("fine_index") / hz
    rise = (F.col("_next.value") - F.col("value")) / (F.col("_next.time_sec") - F.col("time_sec"))
    level = F.coalesce(F.col("value") + (x - F.col("time_sec")) * rise, F.col("value"))
    return linked.select(*keys, "time_sec", "value", "_next", steps).select(*keys, "fine_index", level.alias("value"))


def convolve_and_sample(series: DataFrame, scans: DataFrame, clock: ScanClock, keys: Sequence[str] = ("language", "canonical_run")) -> DataFrame:
    """Sum of kernel-weighted fine-grid values at every scan reached: (keys.., scan, value)."""
    rows = series.join(scans, ["language", "canonical_run"])
    rows = rows.select(
        *keys, "fine_index", "value", "n_scans",
        _scans_reached(F.col("fine_index"), F.col("fine_index") + clock.reach, F.col("n_scans"), clock),
    )
    lag = (sample_index(F.col("scan"), F.col("n_scans"), clock) - F.col("fine_index")).cast("int")
    rows = rows.withColumn("_lag", lag).where((F.col("_lag") >= 0) & (F.col("_lag") < clock.reach))
    return rows.groupBy(*keys, "scan").agg(
        F.sum(F.col("value") * F.element_at(_lookup(clock.kernel), F.col("_lag") + 1)).alias("value")
    )


def scan_grid(scans: DataFrame) -> DataFrame:
    return scans.select("language", "canonical_run", "n_scans", F.explode(F.sequence(F.lit(0), F.col("n_scans").cast("int") - 1)).alias("scan"))


def drift_terms(scans: DataFrame, clock: ScanClock, cutoff_sec: float = 128.0) -> DataFrame:
    """Intercept, linear trend -1..1 and discrete cosines below the cut-off, as (.., scan, name, value)."""
    grid = scan_grid(scans)
    n, scan = F.col("n_scans").cast("double"), F.col("scan").cast("double")
    trend = F.when(n > 1, F.lit(-1.0) + F.lit(2.0) * scan / (n - 1)).otherwise(F.lit(-1.0))
    count = F.floor(F.lit(2.0) * n * F.lit(clock.tr) / F.lit(cutoff_sec)).cast("int")
    pi = F.lit(math.pi)
    cosines = F.transform(
        F.when(count >= 1, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>")),
        lambda k: F.struct(
            F.format_string("highpass_%02d", k - 1).alias("name"),
            F.cos(pi * (scan + F.lit(0.5)) * k / n).alias("value"),
        ),
    )
    fixed = F.array(
        F.struct(F.lit("intercept").alias("name"), F.lit(1.0).alias("value")),
        F.struct(F.lit("linear_trend").alias("name"), trend.alias("value")),
    )
    return grid.select("language", "canonical_run", "scan", F.inline(F.concat(fixed, cosines)))


# Picture presentations (onset, duration in seconds), shown in the first run of two languages.
PICTURES = ((10.0, 15.0), (35.0, 20.0), (60.0, 15.0))
PICTURE_LANGUAGES = ("EN", "ZH")
PICTURE_RUN = 1
ACOUSTIC_NAMES = ("f0", "picture_block", "picture_event", "rms", "sentence_onset", "word_rate")


def picture_events(scans: DataFrame, first_run: int = PICTURE_RUN) -> DataFrame:
    shown = F.array(*[F.struct(F.lit(on).alias("onset_sec"), F.lit(length).alias("duration_sec")) for on, length in PICTURES])
    return scans.where(F.col("language").isin(*PICTURE_LANGUAGES) & (F.col("canonical_run") == first_run)).select(
        "language", "canonical_run", F.inline(shown)
    )


def acoustic_terms(
    *, intensity: DataFrame, pitch: DataFrame, word_onsets: DataFrame, timing: DataFrame, scans: DataFrame,
    clock: ScanClock, first_run: int = PICTURE_RUN,
) -> DataFrame:
    """Convolved acoustic regressors in long form; cells no event reaches are absent (zero).

    All fine-grid series go through one convolution, so the scan explosion and its shuffle happen once.
    """
    pictures = picture_events(scans, first_run)
    series = {
        "rms": interpolated(intensity, scans, clock),
        "f0": interpolated(pitch, scans, clock),
        "word_rate": impulses(word_onsets, scans, clock),
        "sentence_onset": impulses(timing, scans, clock),
        "picture_event": impulses(pictures, scans, clock),
        "picture_block": boxcars(pictures, scans, clock),
    }
    stacked = None
    for name, df in series.items():
        named = df.withColumn("name", F.lit(name))
        stacked = named if stacked is None else stacked.unionByName(named)
    return convolve_and_sample(stacked, scans, clock, ("language", "canonical_run", "name"))


def align_terms(terms: DataFrame, names: Sequence[str], scans: DataFrame) -> DataFrame:
    """One row per scan with an ARRAY of the named terms in the given (sorted) order, gaps filled with 0."""
    cells = terms.groupBy("language", "canonical_run", "scan").agg(
        F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("_m")
    )
    filled = F.array(*[F.coalesce(F.try_element_at("_m", F.lit(n)), F.lit(0.0)) for n in names])
    return (
        scan_grid(scans).join(cells, ["language", "canonical_run", "scan"], "left")
        .select("language", "canonical_run", "scan", filled.alias("z"))
    )


def term_names(drift: DataFrame) -> list[str]:
    """Sorted union of the drift column names over all runs (a handful per study)."""
    return sorted(row["name"] for row in drift.select("name").distinct().collect())


def nuisance_rows(drift: DataFrame, acoustic: DataFrame, scans: DataFrame) -> DataFrame:
    """Drift terms, then acoustic terms, side by side per scan."""
    names = term_names(drift) + list(ACOUSTIC_NAMES)
    return align_terms(drift.unionByName(acoustic.select(*drift.columns)), names, scans)


def pooled_basis(basis: DataFrame) -> DataFrame:
    """Weights of equal (language, run, scan, row of features) added up. Where sentences share feature rows, numbers are summed before any
    vector is met: at most runs x scans x feature rows of them are left, however many sentences there are."""
    return basis.groupBy("language", "canonical_run", "scan", "triplet_row_index").agg(F.sum("weight").alias("weight"))


def shared_basis(timing: DataFrame, scans: DataFrame, clock: ScanClock) -> DataFrame:
    """``pooled_basis`` of timed sentences. They are dealt by row of features before they reach scans, so what is shuffled is one row a
    sentence, never one for each scan of a sentence. ``scans`` has a row per run and language, and is broadcast."""
    return pooled_basis(sentence_basis(timing.repartition("language", "canonical_run", "triplet_row_index"), F.broadcast(scans), clock))


def design_rows(
    basis: DataFrame, features: DataFrame, setting: Sequence[str], *, bucket: int = 32, hot: int = 4096, lane: int = 16, dealt: bool = False
) -> DataFrame:
    """Basis x features: the weighted sum of sentence vectors in every scan (sparse product).

    A vector is shuffled once per bucket of scans its sentence reaches, not once per scan, and is spread
    over the scans only where they are summed. Buckets with more than ``hot`` sentences are split by a
    salt. Vectors are summed in lanes of ``lane`` values by generated code. A ``dealt`` basis lies by run and sentence; it is
    packed where it lies and stored, as it is read twice.
    """
    keys = [*setting, "canonical_run"]
    packed = (
        (basis if dealt else basis.repartition("language", "triplet_row_index"))
        .groupBy("language", "canonical_run", "triplet_row_index", F.floor(F.col("scan") / F.lit(bucket)).alias("_bucket"))
        .agg(F.collect_list(F.struct("scan", "weight")).alias("_weights"))
    )
    packed = cut(packed) if dealt else packed
    crowd = packed.groupBy("language", "canonical_run", "_bucket").agg(F.ceil(F.count(F.lit(1)) / F.lit(hot)).alias("_salts"))
    salted = packed.join(crowd, ["language", "canonical_run", "_bucket"]).withColumn(
        "_salt", F.pmod(F.xxhash64("triplet_row_index"), F.col("_salts"))
    )
    spread = (
        salted.join(features, ["language", "triplet_row_index"])
        .select(*keys, "_bucket", "_salt", F.col("_weights.scan").alias("_scans"), F.col("_weights.weight").alias("_weights"), "vec")
        .repartition(*keys, "_bucket", "_salt")  # weights and vector travel once, not once for each lane
        .select(*keys, "_bucket", "_salt", "_scans", "_weights", F.posexplode(lanes(F.col("vec"), lane)).alias("_lane", "_part"))
        .select(*keys, "_bucket", "_salt", "_lane", "_part", F.inline(F.arrays_zip(F.col("_scans").alias("scan"), F.col("_weights").alias("weight"))))
    )
    partial = spread.groupBy(*keys, "_bucket", "_salt", "_lane", "scan").agg(*lane_sums(F.col("_part"), lane, F.col("weight")))
    whole = partial.repartition(*keys, "scan").groupBy(*keys, "scan", "_lane").agg(*[F.sum(f"_{i}").alias(f"_{i}") for i in range(lane)])
    parts = F.array_sort(F.collect_list(F.struct("_lane", lane_values(lane).alias("_values"))))
    return whole.groupBy(*keys, "scan").agg(parts.alias("_p")).select(*keys, "scan", F.flatten(F.col("_p._values")).alias("x"))


def family_series(bold: DataFrame, metadata: DataFrame) -> DataFrame:
    """Mean series of each region family per subject; ``roi_index`` of the metadata is 1-based."""
    return (
        bold.join(metadata.select("roi_index", "roi_family"), "roi_index")
        .groupBy("language", "subject_id", "roi_family", "canonical_run", "scan")
        .agg(F.avg(F.col("value").cast("double")).alias("value"))
    )


def stacked_targets(bold: DataFrame, targets: DataFrame, scans: DataFrame, chunk: int = 512) -> DataFrame:
    """Target values per scan as an ARRAY ordered by target index, one row per chunk of targets.

    ``targets`` numbers the (subject, region) columns of each language from 0. Missing cells are 0.
    """
    numbered = bold.join(targets, ["language", "subject_id", "roi_index"]).withColumn("chunk", F.floor(F.col("target_index") / F.lit(chunk)).cast("int"))
    cells = numbered.groupBy("language", "canonical_run", "scan", "chunk").agg(
        F.map_from_entries(F.collect_list(F.struct("target_index", F.col("value").cast("double")))).alias("_m")
    )
    widths = targets.groupBy("language").agg((F.max("target_index") + 1).alias("_n"))
    chunks = widths.select(
        "language", "_n", F.explode(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / F.lit(chunk)).cast("int"))).alias("chunk")
    )
    wanted = F.sequence((F.col("chunk") * chunk).cast("bigint"), (F.least(F.col("_n"), (F.col("chunk") + 1) * chunk) - 1).cast("bigint"))
    values = F.transform(wanted, lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0)))
    return (
        scan_grid(scans).join(chunks, "language")
        .join(cells, ["language", "canonical_run", "scan", "chunk"], "left")
        .select("language", "canonical_run", "scan", "chunk", values.alias("y"))
    )


def response_window(timing: DataFrame, scans: DataFrame, clock: ScanClock) -> DataFrame:
    """Scans with onset + 2 s <= time < offset + 12 s, per sentence."""
    # The window opens 2 s after the onset and closes 12 s after the offset.
    low = F.greatest(F.lit(0), F.ceil((F.col("onset_sec") + 2.0) / F.lit(clock.tr)) - 1).cast("int")
    high = F.least(F.col("n_scans") - 1, F.ceil((F.col("offset_sec") + 12.0) / F.lit(clock.tr))).cast("int")
    span = F.explode(F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))).alias("scan")
    time = F.col("scan") * F.lit(clock.tr)
    return (
        timing.join(scans, ["language", "canonical_run"])
        .select("language", "canonical_run", "triplet_row_index", "onset_sec", "offset_sec", span)
        .where((time >= F.col("onset_sec") + 2.0) & (time < F.col("offset_sec") + 12.0))
        .select("language", "canonical_run", "triplet_row_index", "scan")
    )
