"""Signal preparation: re-referencing, filters, resampling, windows, interval labels, spectra."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillwave.functions.ordering import with_global_sums, with_group_max

CHUNK = 1 << 14
#: Kernels of more taps are applied by spectra of blocks of SPECTRUM samples (a power of two over the taps, if they are more).
DIRECT, SPECTRUM = 64, 1 << 12


def average_reference(samples: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Subtract the mean over the channels of each (recording, sample)."""
    return samples.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(*by)))


def sinc_kernel(rate: float, low: float | None, high: float | None, taps: int) -> np.ndarray:
    """Zero-phase windowed-sinc kernel (Hamming) that passes low to high Hz; None leaves that side open."""
    n = np.arange(taps) - (taps - 1) / 2
    window = np.hamming(taps)

    def low_pass(f: float) -> np.ndarray:
        k = np.sinc(2 * f / rate * n) * window
        return k / k.sum()

    whole = np.zeros(taps)
    whole[(taps - 1) // 2] = 1.0
    return (low_pass(high) if high else whole) - (low_pass(low) if low else 0)


def notch_kernel(rate: float, stop: float, width: float, taps: int) -> np.ndarray:
    """All but stop - width/2 to stop + width/2 Hz."""
    whole = np.zeros(taps)
    whole[(taps - 1) // 2] = 1.0
    return whole - sinc_kernel(rate, stop - width / 2, stop + width / 2, taps)


def kernel_spectrum(kernel: np.ndarray) -> np.ndarray:
    return np.fft.rfft(kernel, max(SPECTRUM, 1 << (4 * len(kernel)).bit_length()))


def overlap_save(line: np.ndarray, spectrum: np.ndarray, taps: int) -> np.ndarray:
    """The valid part of the convolution of a line with the kernel of the spectrum."""
    size = 2 * (len(spectrum) - 1)
    step, valid = size - taps + 1, len(line) - taps + 1
    blocks = -(-valid // step)
    padded = np.zeros((blocks - 1) * step + size)
    padded[: len(line)] = line
    # blocks overlap by taps - 1 samples; that many at the start of each transform back are wrapped and dropped
    held = np.lib.stride_tricks.sliding_window_view(padded, size)[::step]
    return np.fft.irfft(np.fft.rfft(held, axis=1) * spectrum, size, axis=1)[:, taps - 1 :].ravel()[:valid]


def fir_filter(samples: DataFrame, kernel: np.ndarray, by: list[str], idx: str = "idx", value: str = "value", out: str = "filtered", chunk: int = CHUNK) -> DataFrame:
    """Convolve each recording with an odd-length kernel, zeros outside it.

    Recordings are cut into chunks of samples that carry copies of the half kernel on both sides, so no task holds a whole one.
    A long kernel is applied by overlap-save: its spectrum is made once, and a block costs two transforms whatever the taps.
    """
    half = len(kernel) // 2
    weights = np.asarray(kernel, float)[::-1].copy()
    spectrum = kernel_spectrum(weights[::-1]) if len(weights) > DIRECT else None
    own = F.floor(F.col(idx) / chunk)
    halo = F.array_distinct(F.array(own, F.floor((F.col(idx) - half) / chunk), F.floor((F.col(idx) + half) / chunk)))
    dealt = samples.withColumn("_chunk", F.explode(halo)).where("_chunk >= 0")

    def convolve(table: pa.Table) -> pa.Table:
        table = table.sort_by(idx)
        at = table.column(idx).to_numpy()
        first = table.column("_chunk")[0].as_py() * chunk
        line = np.zeros(chunk + 2 * half)
        place = at - first + half
        line[place] = table.column(value).to_numpy(zero_copy_only=False)
        result = np.convolve(line, weights[::-1], "valid") if spectrum is None else overlap_save(line, spectrum, len(weights))
        mine = (at >= first) & (at < first + chunk)
        kept = table.filter(pa.array(mine))
        return kept.append_column(out, pa.array(result[at[mine] - first]))

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields) + f", `{out}` double"
    return dealt.groupBy(*by, "_chunk").applyInArrow(convolve, ddl).drop("_chunk")


def decimate(samples: DataFrame, factor: int, idx: str = "idx") -> DataFrame:
    """Every factor-th sample of a low-passed recording, renumbered."""
    return samples.where(F.pmod(F.col(idx), F.lit(factor)) == 0).withColumn(idx, (F.col(idx) / factor).cast("long"))


def resampling_kernel(up: int, down: int, rate: float, half: int, share: float = 0.9) -> np.ndarray:
    """Low-pass at `up` times the rate with 2 * half + 1 taps that sum to `up`: what the lower of both rates can't hold is cut, from `share` of its half on."""
    edge = share * min(rate, rate * up / down) / 2
    return sinc_kernel(rate * up, None, edge, 2 * half + 1) * up


def resample_rational(samples: DataFrame, up: int, down: int, kernel: np.ndarray, by: list[str], idx: str = "idx", value: str = "value", chunk: int = 1 << 12) -> DataFrame:
    """(by, idx, value) at up / down times the rate: sample m lies at m * down / up of the old ones, up to the last of them.

    The kernel is parted into `up` phases, and an output sample is one phase's product with the samples around it: neither the
    zeros between upsampled values nor samples that are dropped later are computed. Output is made in chunks of samples, to
    which the input is dealt with the halo it needs; zeros are taken outside a recording.
    """
    half = len(kernel) // 2
    taps = -(-len(kernel) // up)
    # phase r: the taps at distances r, r + up, ... from the kernel's start, for k counted upwards
    padded = np.zeros(taps * up)
    padded[: len(kernel)] = kernel
    phases = padded.reshape(taps, up).T[:, ::-1].copy()
    first_out, last_out = F.ceil((F.col(idx) * up - half) / down), F.floor((F.col(idx) * up + half) / down)
    # a sample also goes where it is the one at or behind an output, which tells that the recording reaches so far
    reach = F.sequence(F.floor(F.greatest(F.lit(0), F.least(first_out, F.ceil((F.col(idx) - 1) * up / down))) / chunk), F.floor(F.greatest(F.lit(0), last_out, F.floor(F.col(idx) * up / down)) / chunk))
    dealt = samples.select(*by, F.col(idx).cast("long").alias(idx), F.col(value).cast("double").alias(value)).withColumn("_chunk", F.explode(reach))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name != "_chunk")

    def compute(table: pa.Table) -> pa.Table:
        at, x = table.column(idx).to_numpy(), table.column(value).to_numpy(zero_copy_only=False)
        m = np.arange(chunk) + table.column("_chunk")[0].as_py() * chunk
        have = np.zeros(int(m[-1]) * down // up + 2 - (base := int(at.min())) if len(at) else 0, bool)
        inside = at[(at - base >= 0) & (at - base < len(have))]
        have[inside - base] = True
        behind = -(-m * down // up) - base
        m = m[(behind >= 0) & (behind < len(have)) & have[np.clip(behind, 0, len(have) - 1)]]
        top = (m * down + half) // up  # the last input that the kernel reaches
        phase = m * down + half - top * up
        line = np.zeros(int(at.max()) - base + 2 * taps + 2)
        line[at - base + taps] = x
        place = top[:, None] - base + taps + np.arange(1 - taps, 1)
        inside2 = (place >= 0) & (place < len(line))
        got = (np.where(inside2, line[np.clip(place, 0, len(line) - 1)], 0.0) * phases[phase]).sum(1)
        columns = {c: pa.array([table.column(c)[0].as_py()] * len(m), table.schema.field(c).type) for c in by}
        return pa.table({**columns, idx: pa.array(m, pa.int64()), value: pa.array(got)})

    return dealt.groupBy(*by, "_chunk").applyInArrow(compute, schema)


def resample_linear(samples: DataFrame, ratio: float, by: list[str], idx: str = "idx", value: str = "value") -> DataFrame:
    """Samples at k / ratio by linear interpolation between neighbours; (by, idx, value)."""
    here = samples.select(*by, F.col(idx).alias("_i"), F.col(value).alias("_a"))
    ahead = samples.select(*by, (F.col(idx) - 1).alias("_i"), F.col(value).alias("_b"))
    # a last sample without a neighbour gives the target sample on it, if there is one
    both = here.join(ahead, [*by, "_i"], "left")
    first = F.ceil(F.col("_i") * F.lit(ratio))
    last = F.when(F.col("_b").isNotNull(), F.ceil((F.col("_i") + 1) * F.lit(ratio)) - 1).otherwise(F.floor(F.col("_i") * F.lit(ratio)))
    out = both.where(last >= first).withColumn("_k", F.explode(F.sequence(first, last)))
    share = F.col("_k") / F.lit(ratio) - F.col("_i")
    return out.select(*by, F.col("_k").alias(idx), (F.col("_a") + share * (F.coalesce("_b", "_a") - F.col("_a"))).alias(value))


def sliding_windows(samples: DataFrame, n: int, step: int, by: list[str], idx: str = "idx", value: str = "value") -> DataFrame:
    """Full windows of n samples every `step`: (by, window_index, start, x, exclusive).

    Windows may end exactly with the recording; `exclusive` is false for that last one, which a stricter policy drops.
    """
    last, first = F.floor(F.col(idx) / step), F.greatest(F.lit(0), F.ceil((F.col(idx) - n + 1) / step))
    dealt = samples.where(last >= first).withColumn("window_index", F.explode(F.sequence(first, last)))
    made = dealt.groupBy(*by, "window_index").agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(idx).alias("i"), F.col(value).alias("v")))), lambda s: s["v"]).alias("x")).where(F.size("x") == n)
    ends = samples.groupBy(*by).agg((F.max(idx) + 1).alias("_T"))
    start = F.col("window_index") * step
    return made.join(ends, by).select(*by, "window_index", start.alias("start"), "x", (start + n < F.col("_T")).alias("exclusive"))


def window_grid(recordings: DataFrame, by: list[str], length: float, step: float, duration: Column) -> DataFrame:
    """(by, t_start, t_end) of all windows that fit into each recording's duration in seconds."""
    count = F.floor((duration - length) / step) + 1
    grid = recordings.where(count > 0).withColumn("_k", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    return grid.select(*by, (F.col("_k") * float(step)).alias("t_start"), (F.col("_k") * float(step) + float(length)).alias("t_end"))


@dataclass(frozen=True)
class Ask:
    """What a window asks of the annotations of its recording, at a point of its own.

    `reach`: the greatest offset of those that begin before the point (`at`: or at it); `next`: the least onset from the point
    on. `where` leaves annotations out.
    """

    kind: str
    point: Column
    at: bool = False
    where: Column | None = None


@dataclass(frozen=True)
class Label:
    """A label as an expression over t_start, t_end and the answers to its asks."""

    asks: dict[str, Ask]
    label: Column


def label_windows(windows: DataFrame, annotations: DataFrame, by: list[str], label: Label) -> DataFrame:
    """windows with the greatest label (0 if none) that the annotations (onset, offset) of their recording give.

    A sweep: points and annotations lie in one sorted range a question, and a running maximum answers each window, carried over
    the borders of ranges. Every annotation is there once a question however long it is, and no task holds a recording.
    """
    keys = [F.col(c) for c in by]
    points = windows.select(*by, "t_start", "t_end").distinct()
    none = F.lit(None).cast("double")
    rows = None
    for name, ask in label.asks.items():
        ahead = ask.kind == "next"
        turned = (lambda c: -c) if ahead else (lambda c: c)
        held = annotations.where(F.col("onset").isNotNull() & F.col("offset").isNotNull() & (F.lit(True) if ask.where is None else ask.where))
        # in a tie the point stands before the annotations that begin at it, unless it asks for them too
        a = held.select(*keys, F.lit(name).alias("_ask"), turned(F.col("onset").cast("double")).alias("_at"), F.lit(1).alias("_tie"), none.alias("t_start"), none.alias("t_end"), turned(F.col("onset") if ahead else F.col("offset")).cast("double").alias("_reach"))
        p = points.select(*keys, F.lit(name).alias("_ask"), turned(ask.point.cast("double")).alias("_at"), F.lit(2 if ahead or ask.at else 0).alias("_tie"), F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"), none.alias("_reach"))
        rows = a.unionByName(p) if rows is None else rows.unionByName(a).unionByName(p)
    swept = with_group_max(rows, [*by, "_ask"], [F.col("_at"), F.col("_tie")], {"_found": F.col("_reach")}).where(F.col("_tie") != 1)
    answers = [F.max(F.when(F.col("_ask") == n, -F.col("_found") if ask.kind == "next" else F.col("_found"))).alias(n) for n, ask in label.asks.items()]
    met = swept.groupBy(*by, "t_start", "t_end").agg(*answers).select(*by, "t_start", "t_end", label.label.alias("label"))
    return windows.join(met, [*by, "t_start", "t_end"], "left").withColumn("label", F.coalesce("label", F.lit(0)))


def label_grid(recordings: DataFrame, annotations: DataFrame, by: list[str], length: float, step: float, duration: Column, label: Label) -> DataFrame:
    """(by, t_start, t_end, label): the windows of `window_grid` over recordings (one row each) with the labels of `label_windows`.

    Only annotations are shuffled. On a regular grid each one tells from which window on (or up to which) it answers, so
    the answers change at few windows of a recording; between, they hold for a run of windows that is made where it is used.
    A recording has one row a window at most where answers change, however many annotations it has.
    """
    held = recordings.where(F.floor((duration - length) / step) >= 0).select(*by, F.floor((duration - length) / step).alias("_last"))
    noted = annotations.where(F.col("onset").isNotNull() & F.col("offset").isNotNull()).select(*by, F.col("onset").cast("double").alias("onset"), F.col("offset").cast("double").alias("offset"))
    noted = noted.join(held, by).withColumns({"t_start": F.lit(0.0), "t_end": F.lit(float(length))})
    names, asks = list(label.asks), label.asks
    none = {n: F.lit(None).cast("double") for n in names}
    cells = held.select(*by, F.lit(0).cast("long").alias("_k"), "_last", *[v.alias(n) for n, v in none.items()])
    for name, ask in asks.items():
        # about the window whose point meets the onset: the points themselves decide, as rounding may be off by one
        about = F.floor(F.greatest(F.lit(-2.0), F.least(F.col("_last") + 2.0, (F.col("onset") - ask.point) / step)))
        near = lambda a, b, at=about: F.array_distinct(F.transform(F.sequence(at + a, at + b), lambda k: F.greatest(F.lit(0).cast("long"), F.least(F.col("_last"), k))))
        tried = (noted if ask.where is None else noted.where(ask.where)).withColumn("_k", F.explode(near(-1, 2)))
        tried = tried.withColumns({"t_start": F.col("_k") * float(step), "t_end": F.col("_k") * float(step) + float(length)})
        if ask.kind == "next":
            meets = tried.where(ask.point <= F.col("onset"))
            # behind the last window that an onset answers, another may answer: a row there begins a new run
            found = meets.select(*by, F.col("_last"), F.explode(F.array(F.struct(F.col("_k"), F.col("onset").alias("_v")), F.struct((F.col("_k") + 1).alias("_k"), F.lit(None).cast("double").alias("_v")))).alias("_c"))
            found = found.select(*by, "_last", F.col("_c._k").alias("_k"), F.col("_c._v").alias("_v")).where("_k <= _last")
        else:
            meets = tried.where(ask.point >= F.col("onset") if ask.at else ask.point > F.col("onset"))
            found = meets.select(*by, "_last", "_k", F.col("offset").alias("_v"))
        cells = cells.unionByName(found.select(*by, "_k", "_last", *[(F.col("_v") if n == name else v).alias(n) for n, v in none.items()]))
    fold = {n: F.min if asks[n].kind == "next" else F.max for n in names}
    cells = cells.groupBy(*by, "_k").agg(F.max("_last").alias("_last"), *[fold[n](n).alias(n) for n in names])
    ahead, back = Window.partitionBy(*by).orderBy("_k"), Window.partitionBy(*by).orderBy(F.col("_k").desc())
    own = lambda n: (back if asks[n].kind == "next" else ahead).rowsBetween(Window.unboundedPreceding, 0)
    runs = cells.select(*by, "_k", F.coalesce(F.lead("_k").over(ahead) - 1, "_last").alias("_to"), *[fold[n](n).over(own(n)).alias(n) for n in names])
    out = runs.withColumn("_k", F.explode(F.sequence("_k", "_to")))
    out = out.withColumns({"t_start": F.col("_k") * float(step), "t_end": F.col("_k") * float(step) + float(length)})
    return out.select(*by, "t_start", "t_end", F.coalesce(label.label, F.lit(0)).alias("label"))


def overlap_label(pre_min: float = 30.0, pre_max: float = 120.0) -> Label:
    """2 if the window overlaps an event, else 1 if an event begins pre_min to pre_max seconds after its end."""
    asks = {"_reached": Ask("reach", F.col("t_end")), "_onset": Ask("next", F.col("t_end") + pre_min)}
    return Label(asks, F.when(F.col("_reached") > F.col("t_start"), 2).when(F.col("_onset") <= F.col("t_end") + pre_max, 1).otherwise(0))


def fraction_label(length: float, share: float = 0.5, horizon: float = 900.0) -> Label:
    """2 if one event covers `share` of a window of this length, else 1 if the window ends after an onset - horizon and starts by that onset.

    An event covers so much of a window where it lasts so long itself, begins so long before the window's end and ends so long
    after its start.
    """
    least = share * length
    asks = {"_reached": Ask("reach", F.col("t_end") - least, True, F.col("offset") - F.col("onset") >= least), "_onset": Ask("next", F.col("t_start"))}
    before = F.col("_onset").isNotNull() & (F.col("t_end") > F.greatest(F.lit(0.0), F.col("_onset") - horizon))
    return Label(asks, F.when(F.col("_reached") >= F.col("t_start") + least, 2).when(before, 1).otherwise(0))


def preictal_intervals(annotations: DataFrame, duration: float = 60.0) -> DataFrame:
    """(…, window_start, window_end, window_duration) before each onset; the duration is held within 30 to 120 s."""
    d = min(120.0, max(30.0, duration))
    return annotations.withColumns({"window_start": F.greatest(F.lit(0.0), F.col("onset") - d), "window_end": F.col("onset"), "window_duration": F.lit(d)})


def long_enough(samples: DataFrame, by: list[str], n: int) -> DataFrame:
    """Samples of recordings that have at least n."""
    return samples.join(samples.groupBy(*by).count().where(F.col("count") >= n).select(*by), by, "left_semi")


def row_offsets(counts: DataFrame, key: str, n: str = "n") -> DataFrame:
    """(key, n, offset): where each patient's rows begin in the dense global order by key."""
    return with_global_sums(counts.select(key, n), [F.col(key)], {"_end": F.col(n)}).select(key, n, (F.col("_end") - F.col(n)).alias("offset"))


def locate(indexes: DataFrame, offsets: DataFrame, key: str, index: str, rows: int, bucket: int = 4096) -> DataFrame:
    """(…, key, local): the patient and local row of global indexes; negative ones count from the end, others out of range are NULL."""
    at = F.when(F.col(index) < 0, F.col(index) + rows).otherwise(F.col(index))
    wanted = indexes.withColumn("_at", at).withColumn("_b", F.floor(F.col("_at") / bucket))
    spans = offsets.where("n > 0").select(key, "n", "offset", F.explode(F.sequence(F.floor(F.col("offset") / bucket), F.floor((F.col("offset") + F.col("n") - 1) / bucket))).alias("_b"))
    met = (F.col("w._b") == F.col("s._b")) & (F.col("w._at") >= F.col("s.offset")) & (F.col("w._at") < F.col("s.offset") + F.col("s.n"))
    return wanted.alias("w").join(spans.alias("s"), met, "left").select(*[f"w.{c}" for c in indexes.columns], f"s.{key}", (F.col("w._at") - F.col("s.offset")).alias("local"))


def welch_psd(df: DataFrame, x: str = "x", rate: float = 128.0, segment: int = 256, out: str = "psd") -> DataFrame:
    """One-sided power density by Welch's method (Hann, constant detrend, half overlap, mean) for an array column.

    Adds `out` and `<out>_step`, the distance of its bins in Hz. The transform is numpy's over batches of equal lengths.
    """
    fields = df.schema.fields
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` array<double>, `{out}_step` double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(x)
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            result: list[np.ndarray | None] = [None] * len(sizes)
            steps = np.zeros(len(sizes))
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                if not n:
                    for i in rows:
                        result[i] = np.zeros(0)
                    continue
                data = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), n)
                power, step = density(data, rate, segment)
                steps[rows] = step
                for i, p in zip(rows, power, strict=True):
                    result[i] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(result, pa.list_(pa.float64())), pa.array(steps)], names=[*batch.schema.names, out, f"{out}_step"])

    return df.mapInArrow(run, ddl)


def density(data: np.ndarray, rate: float, segment: int = 256) -> tuple[np.ndarray, float]:
    """Welch densities of equally long rows, and the distance of the bins."""
    n = min(segment, data.shape[1])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    hop = n - n // 2
    parts = []
    for lo in range(0, data.shape[1] - n + 1, hop):
        part = data[:, lo : lo + n]
        parts.append(np.abs(np.fft.rfft((part - part.mean(1, keepdims=True)) * window, axis=1)) ** 2)
    power = np.mean(parts, 0) / (rate * (window**2).sum())
    power[:, 1 : (n + 1) // 2] *= 2
    return power, rate / n


def assemble_vectors(df: DataFrame, keys: list[str], channel: str, columns: list[str], channels: int) -> DataFrame:
    """(keys, names, vector) of every window with all its channels: channel after channel, names <channel>__<feature>."""
    own = F.struct(F.col(channel).alias("channel"), F.array(*columns).alias("values"))
    whole = df.groupBy(*keys).agg(F.sort_array(F.collect_list(own)).alias("parts")).where(F.size("parts") == channels)
    names = F.flatten(F.transform("parts", lambda p: F.array(*[F.concat(p["channel"].cast("string"), F.lit(f"__{c}")) for c in columns])))
    return whole.select(*keys, names.alias("names"), F.flatten(F.transform("parts", lambda p: p["values"])).alias("vector"))
