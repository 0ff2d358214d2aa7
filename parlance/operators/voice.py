"""Signal tables, speech segments and the map between cut and original time.

Frames are ``(session, f, value)``, segments ``(session, start_f, end_f)`` with the end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parlance.functions.fixed import ENERGY_THRESHOLD_DB, SAMPLE_RATE
from parlance.lineage import cut
from parlance.operators.ordered import Layout, islands, lookup, overlap_join, prefix

FRAMES_PER_BLOCK = 4096


def pcm_to_float(samples: Column) -> Column:
    """16-bit integers to [-1, 1)."""
    return F.transform(samples, lambda x: (x / F.lit(32768.0)).cast("float"))


def downmix(channels: Column) -> Column:
    """Mean over channels of ``array<array<float>>``; all channels are equally long."""
    first = F.transform(channels[0], lambda x: x.cast("double"))
    total = F.aggregate(
        F.slice(channels, 2, F.greatest(F.size(channels) - 1, F.lit(0))),
        first,
        lambda acc, ch: F.zip_with(acc, ch, lambda a, b: a + b),
    )
    return F.transform(total, lambda x: x / F.size(channels))


def split_by_channels(audio: DataFrame, most: int = 2, channels: str = "channels") -> tuple[DataFrame, DataFrame]:
    """Rows of up to ``most`` channels, and the quarantined rest with the reason."""
    n = F.col(channels)
    bad = audio.filter(~F.coalesce(n.between(1, most), F.lit(False)))
    return audio.filter(n.between(1, most)), bad.withColumn(
        "error", F.concat(F.lit(f"more than {most} channels or none: "), F.coalesce(n.cast("string"), F.lit("null")))
    )


def split_by_rate(audio: DataFrame, rate: int = SAMPLE_RATE) -> tuple[DataFrame, DataFrame]:
    """Rows that can be decoded, and the quarantined rest with the reason."""
    good = audio.filter(F.col("rate") == rate)
    bad = audio.filter(~F.col("rate").eqNullSafe(rate)).withColumn(
        "error", F.concat(F.lit(f"sample rate is not {rate}: "), F.coalesce(F.col("rate").cast("string"), F.lit("null")))
    )
    return good, bad


def peak_normalize(samples: DataFrame, clip: str = "clip", value: str = "sample") -> DataFrame:
    """Divide by the clip's peak, at least 0.1."""
    peaks = samples.groupBy(clip).agg(F.max(F.abs(value)).alias("peak"))
    return lookup(samples, peaks, [clip]).withColumn(
        "normalized", F.col(value) / F.greatest(F.col("peak"), F.lit(0.1))
    )


def frame_energy(samples: DataFrame, frame_len: int = 800, value: str = "sample") -> DataFrame:
    """Energy in dB per clip and frame of ``frame_len`` samples (50 ms at 16 kHz)."""
    return (
        samples.groupBy("clip", F.expr(f"idx div {frame_len}").alias("f"))
        .agg(F.sum(F.expr(f"{value} * {value}")).alias("power"), F.count("*").alias("n"))
        .withColumn("db", 20 * F.log10(F.greatest(F.sqrt(F.col("power") / F.col("n")), F.lit(1e-10))))
    )


def vad_segments(
    frames: DataFrame,
    threshold: float = ENERGY_THRESHOLD_DB,
    max_silence: int = 2,
    min_len: int = 2,
    block: int = FRAMES_PER_BLOCK,
    fan: int = 1024,
    lengths: DataFrame | None = None,
) -> DataFrame:
    """Runs of active frames; gaps of up to ``max_silence`` frames are bridged, short runs dropped.

    With ``lengths`` (session, length in frames) the silence bridged in a clip stays below
    ``SILENCE_SHARE`` of its own length.
    """
    active = frames.filter(F.col("value") >= threshold).select("session", "f")
    layout = Layout(("session",), ("f",), f"f div {block}", fan)
    if lengths is None:
        runs = islands(active, layout, ["f"], f"cur.f - prev.f - 1 > {max_silence}")
    else:
        capped = lookup(active, lengths.select("session", capped_silence(max_silence, F.col("length")).alias("bridge")), ["session"], "inner")
        runs = islands(capped, layout, ["f", "bridge"], "cur.f - prev.f - 1 > cur.bridge")
    return runs.selectExpr("session", "head.f as start_f", "tail.f + 1 as end_f").filter(
        F.col("end_f") - F.col("start_f") >= min_len
    )


SILENCE_SHARE = 0.95


def capped_silence(silence: float, length: Column) -> Column:
    """Silence tolerance never reaches the length of the clip; both in one unit."""
    return F.least(F.lit(float(silence)), SILENCE_SHARE * length)


def whole_clip(frames: DataFrame) -> DataFrame:
    """One segment per session that covers everything: detection switched off."""
    return frames.groupBy("session").agg(F.lit(0).cast("long").alias("start_f"), (F.max("f") + 1).alias("end_f"))


def segments_for(frames: DataFrame, method: str | None, **settings) -> DataFrame:
    """Choose the detector by its setting: off, or energy."""
    name = (method or "").strip().lower()
    if name in ("", "false", "0", "no", "off"):
        return whole_clip(frames)
    if name in ("true", "1", "yes", "auditok", "energy"):
        return vad_segments(frames, **settings)
    raise ValueError(f"unknown voice activity method {method!r}")


def explicit_segments(pairs: DataFrame, rate: int) -> DataFrame:
    """User-given ``pair array<double>`` in seconds to samples; a pair must hold two values."""
    ok = F.size("pair") == 2
    return pairs.withColumn("start", F.when(ok, F.rint(F.element_at("pair", 1) * rate).cast("long"))).withColumn(
        "end", F.when(ok, F.rint(F.element_at("pair", -1) * rate).cast("long"))
    ).withColumn("error", F.when(~ok, F.lit("segment needs a start and an end")))


def dilate_merge(
    segments: DataFrame, lengths: DataFrame, by: int, block: int = FRAMES_PER_BLOCK, fan: int = 1024
) -> DataFrame:
    """Widen by ``by`` on both sides inside [0, length] and join what then touches.

    A joined segment takes the end of its newest member, so a nested earlier member does not
    stretch it. ``lengths`` is (session, length).
    """
    if by <= 0:
        return segments.select("session", "start_f", "end_f")
    wide = lookup(segments, lengths, ["session"]).select(
        "session",
        F.col("start_f").alias("at"),
        F.col("end_f").alias("at_end"),
        F.greatest(F.col("start_f") - by, F.lit(0)).alias("s"),
        F.least(F.col("end_f") + by, F.col("length")).alias("e"),
    )
    layout = Layout(("session",), ("at", "at_end"), f"at div {block}", fan)
    runs = islands(wide, layout, ["s", "e"], "prev.e < cur.s")
    return runs.selectExpr("session", "head.s as start_f", "tail.e as end_f")


def speech_map(segments: DataFrame, block: int = FRAMES_PER_BLOCK, fan: int = 1024) -> DataFrame:
    """Add where each segment lies in the cut audio: [obeg, oend) and ioffset = start - obeg."""
    layout = Layout(("session",), ("start_f",), f"start_f div {block}", fan)
    mapped = prefix(segments, layout, obeg=("sum", "end_f - start_f"), seg_idx=("sum", "1L"))
    return mapped.withColumn("oend", F.expr("obeg + end_f - start_f")).withColumn(
        "ioffset", F.expr("start_f - obeg")
    )


def speech_only(
    frames: DataFrame, segments: DataFrame, block: int = FRAMES_PER_BLOCK, fan: int = 1024, avoid_empty: bool = False
) -> DataFrame:
    """Frames inside a segment, renumbered ``g`` in the cut audio.

    Segments must be sorted and disjoint. Segment starts and frames are laid in one order, each
    frame takes the latest start before it, so no frame is compared with every segment. With
    ``avoid_empty`` a session without any segment keeps all of its frames.
    """
    mapped = cut(speech_map(segments, block, fan))
    marks = mapped.selectExpr(
        "session", "start_f as f", "0 as kind", "cast(null as double) as value", "struct(start_f, end_f, ioffset) as seg"
    )
    points = frames.selectExpr(
        "session", "f", "1 as kind", "value",
        "cast(null as struct<start_f:bigint,end_f:bigint,ioffset:bigint>) as seg",
    )
    layout = Layout(("session",), ("f", "kind"), f"f div {block}", fan)
    placed = prefix(marks.unionByName(points), layout, inside=("max", "seg"))
    speech = placed.filter("kind = 1 and f < inside.end_f").selectExpr("session", "f", "f - inside.ioffset as g", "value")
    if not avoid_empty:
        return speech
    silent = frames.join(mapped.select("session").distinct(), "session", "left_anti")
    return speech.unionByName(silent.selectExpr("session", "f", "f as g", "value"))


def remap_timestamps(words: DataFrame, mapped: DataFrame, slot: int = 30_000) -> DataFrame:
    """Times in cut audio to times in the original.

    ``words`` has (session, word_id, t, t2) in ms, ``mapped`` a speech map in ms. A word that
    touches several segments takes the one that changes its length least, then the earliest.
    Words after all speech keep the last offset; those of a session without a map keep their times.
    """
    spans = words.withColumn("__lo", F.least("t", "t2")).withColumn("__hi", F.greatest("t", "t2"))
    side = mapped.select("session", "start_f", "end_f", "obeg", "oend", "ioffset", F.col("seg_idx").alias("__seg"))
    pairs = overlap_join(
        spans, side, ["session"], ("__lo", "__hi"), ("obeg", "oend"),
        "__lo <= oend and (__seg = 0 or obeg < __hi)", slot,
    )
    clamp = "least(greatest(ioffset + {t}, start_f), end_f)"
    best = (
        pairs.withColumn("start_ms", F.expr(clamp.format(t="t")))
        .withColumn("end_ms", F.expr(clamp.format(t="t2")))
        .groupBy(*words.columns)
        .agg(
            F.min(
                F.expr("struct(abs(abs(t2 - t) - abs(end_ms - start_ms)) as cost, __seg, start_ms, end_ms)")
            ).alias("best")
        )
        .select(*words.columns, "best.start_ms", "best.end_ms")
    )
    tails = mapped.groupBy("session").agg(
        F.max("oend").alias("__total"), F.max_by("ioffset", "seg_idx").alias("__offset")
    )
    after = (
        lookup(spans, tails, ["session"])
        .filter("__total is null or __lo > __total")
        .selectExpr(*words.columns, "coalesce(__offset, 0) + t as start_ms", "coalesce(__offset, 0) + t2 as end_ms")
    )
    return best.unionByName(after)


def remap_points(points: DataFrame, mapped: DataFrame, slot: int = 30_000) -> DataFrame:
    """One cut time ``t`` to the original: the first segment that ends at or after it.

    Times of a session without a map stay.
    """
    side = mapped.select("session", "start_f", "end_f", "obeg", "oend", "ioffset", F.col("seg_idx").alias("__seg"))
    inside = overlap_join(
        points, side, ["session"], ("t", "t"), ("obeg", "oend"), "t <= oend and (__seg = 0 or obeg < t)", slot
    ).selectExpr(*points.columns, "least(greatest(ioffset + t, start_f), end_f) as original")
    tails = mapped.groupBy("session").agg(
        F.max("oend").alias("__total"), F.max_by("ioffset", "seg_idx").alias("__offset")
    )
    after = lookup(points, tails, ["session"]).filter("__total is null or t > __total").selectExpr(
        *points.columns, "coalesce(__offset, 0) + t as original"
    )
    return inside.unionByName(after)


def skip_silent_chunks(frames: DataFrame, chunk: int, threshold: float = 50) -> DataFrame:
    """Drop fixed-size chunks without any active frame."""
    framed = frames.withColumn("chunk", F.expr(f"f div {chunk}"))
    silent = framed.groupBy("session", "chunk").agg(F.max("value").alias("top")).filter(F.col("top") < threshold)
    return framed.join(silent, ["session", "chunk"], "left_anti")
