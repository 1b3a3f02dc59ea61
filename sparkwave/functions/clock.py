"""Wall-clock time of samples from clock anchors, exact as a ratio of integers.

Between anchors time is interpolated; outside it is extrapolated at the nominal rate, if asked for and near enough. The
numerator and denominator fit decimals of 38 digits: ticks below 2.7e18, stamps of 32 bits.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import UnsupportedFormatError
from . import exact

KINDS = ("anchor", "interpolated", "extrapolated_nominal")


def at_samples(samples: DataFrame, anchors: DataFrame, origin: int, rate: float, *, extrapolation: str = "error", max_seconds: float = 10.0) -> DataFrame:
    """``samples`` (sample) with numerator, denominator and kind of their ticks; outside the anchors null under "error".

    Anchors bracket samples by an as-of lookup; their number is bounded by a budget, so they are broadcast as ranges. The
    ranges are cut at bins as wide as a range is on average, which makes the lookup a hash join of at most twice as many rows.
    """
    if extrapolation not in ("error", "nominal"):
        raise ValueError("extrapolation must be 'error' or 'nominal'")
    ticks_per_sample = Fraction(exact.TICKS) / Fraction(rate)
    num, den = ticks_per_sample.numerator, ticks_per_sample.denominator
    if max(num, den) >= 10**18:
        raise UnsupportedFormatError("the sample rate has no ratio that fits; use at_sample")
    one = Window.partitionBy(F.lit(1)).orderBy("stamp")  # anchors are bounded by max_clock_anchors
    legs = anchors.select(F.col("stamp").alias("s0"), F.col("ticks").alias("t0"), F.lead("stamp").over(one).alias("s1"), F.lead("ticks").over(one).alias("t1"))
    first = anchors.agg(F.min(F.struct("stamp", "ticks")).alias("first"), F.max(F.struct("stamp", "ticks")).alias("last"))
    big = lambda c: c.cast("decimal(20,0)")
    stamp = F.col("sample") + origin
    low, high, n = anchors.agg(F.min("stamp"), F.max("stamp"), F.count("*")).first()
    width = max(1, (high - low) // n) if n else 1
    after = F.coalesce("s1", F.col("s0") + 1)
    binned = legs.select("*", F.explode(F.sequence(F.floor(F.col("s0") / width), F.floor((after - 1) / width))).alias("_leg"))
    met = samples.join(F.broadcast(binned), (F.floor(stamp / width) == F.col("_leg")) & (stamp >= F.col("s0")) & (stamp < after), "left").join(F.broadcast(first))
    near = F.when(stamp < F.col("first.stamp"), F.col("first")).otherwise(F.col("last"))
    away = stamp - near["stamp"]
    allowed = Fraction(max_seconds) * Fraction(rate)
    nominal = F.lit(extrapolation == "nominal") & (F.abs(away) <= int(allowed))
    kind = F.when(stamp == F.col("s0"), KINDS[0]).when(F.col("s1").isNotNull(), KINDS[1]).when(nominal, KINDS[2])
    exact_in = big(F.col("t0")) * big(F.col("s1") - F.col("s0")) + big(F.col("t1") - F.col("t0")) * big(stamp - F.col("s0"))
    out = big(near["ticks"]) * F.lit(den).cast("decimal(18,0)") + big(away) * F.lit(num).cast("decimal(18,0)")
    to = "decimal(38,0)"
    numerator = F.when(kind == KINDS[0], F.col("t0").cast(to)).when(kind == KINDS[1], exact_in.cast(to)).when(kind == KINDS[2], out.cast(to))
    denominator = F.when(kind == KINDS[0], F.lit(1).cast(to)).when(kind == KINDS[1], (F.col("s1") - F.col("s0")).cast(to)).when(kind == KINDS[2], F.lit(den).cast(to))
    return met.select(*[samples[c] for c in samples.columns], numerator.alias("numerator"), denominator.alias("denominator"), kind.alias("kind"))


def at_sample(sample: int, anchors: list[tuple[int, int]], origin: int, n_samples: int, rate: float, *, extrapolation: str = "error", max_seconds: float = 10.0) -> tuple[Fraction, str]:
    """Ticks and kind of one sample, for any rate; the recording's exclusive end is a sample, too."""
    from bisect import bisect_right

    if not 0 <= sample <= n_samples:
        raise IndexError("the sample lies outside the recording")
    stamp = origin + sample
    i = bisect_right([s for s, _ in anchors], stamp) - 1
    if i >= 0 and anchors[i][0] == stamp:
        return Fraction(anchors[i][1]), KINDS[0]
    if 0 <= i < len(anchors) - 1:
        (s0, t0), (s1, t1) = anchors[i], anchors[i + 1]
        return t0 + Fraction((t1 - t0) * (stamp - s0), s1 - s0), KINDS[1]
    if extrapolation != "nominal":
        raise ValueError("the sample lies outside the clock anchors")
    s, t = anchors[max(i, 0)]
    if abs(stamp - s) > Fraction(max_seconds) * Fraction(rate):
        raise ValueError("the sample lies too far from the clock anchors")
    return t + Fraction(stamp - s) * exact.TICKS / Fraction(rate), KINDS[2]
