"""Scalar expressions of rain, runoff, storage, probability and text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Num = Column | float | int


def col(x: Num | str) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, lo: Num, hi: Num) -> Column:
    return F.greatest(F.least(x, col(hi)), col(lo))


def erf(x: Column) -> Column:
    """Abramowitz and Stegun 7.1.26; absolute error below 1.5e-7."""
    a = F.abs(x)
    t = 1.0 / (1.0 + 0.3275911 * a)
    p = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.signum(x) * (1.0 - p * F.exp(-a * a))


def phi(x: Column) -> Column:
    """The standard normal distribution function."""
    return 0.5 * (1.0 + erf(x / 1.4142135623730951))


def dress(ratio: Column, sigma: Num, bias: Num = 1.0) -> Column:
    """Probability that the true value reaches a threshold which a scenario reaches `ratio` times over."""
    return phi(F.log(F.greatest(col(bias) * ratio, F.lit(1e-9))) / col(sigma))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1.0 - p))


def areal_reduction(area_km2: Column) -> Column:
    return clip(1.0 - F.log10(F.greatest(area_km2, F.lit(1.0))) / 15.0, 0.5, 1.0)


def duration_threshold(t1: Column, t12: Column, hours: Num) -> Column:
    """Power law through the thresholds of 1 and 12 hours."""
    return t1 * F.pow(col(hours), F.log(t12 / t1) / F.log(F.lit(12.0)))


def response_time(area_km2: Column, a: float, b: float, most: float) -> Column:
    return clip(a * F.pow(area_km2, F.lit(b)), 1.0, most)


def runoff_depth(wetness: Column, p0: Num, s: Num) -> Column:
    """Depth that runs off once the store exceeds its initial loss."""
    x = F.greatest(wetness - col(p0), F.lit(0.0))
    return F.when(x > 0, x * x / (x + col(s))).otherwise(0.0)


def runoff_coefficient(wetness: Column, p0: Num, s: Num) -> Column:
    """Its derivative: the share of the next millimetre that runs off."""
    x = F.greatest(wetness - col(p0), F.lit(0.0))
    return x * (x + 2.0 * col(s)) / F.pow(x + col(s), F.lit(2.0))


def rain_rate(dbz: Column, convective: Column) -> Column:
    """mm/h of a reflectivity: capped at 57 dBZ, nothing below 7; null stays null."""
    z = F.pow(F.lit(10.0), F.least(dbz, F.lit(57.0)) / 10.0)
    rate = F.when(convective, F.pow(z / 300.0, F.lit(1 / 1.4))).otherwise(F.pow(z / 200.0, F.lit(1 / 1.6)))
    return F.when(dbz.isNull(), None).when(dbz < 7, 0.0).otherwise(rate)


def blend_weight(lead: Column, first: float = 1.0, last: float = 4.0) -> Column:
    """1 until `first`, 0 from `last`, a half cosine between."""
    x = clip((lead - first) / (last - first), 0.0, 1.0)
    return 0.5 * (1.0 + F.cos(F.pi() * x))


def aged_weight(family: Column, member: Column, age_h: Column, half_life_h: Num) -> Column:
    return family * member * F.pow(F.lit(0.5), age_h / col(half_life_h))


def ramp(x: Column, lo: float, hi: float) -> Column:
    return clip((x - lo) / (hi - lo), 0.0, 1.0)


def ingredients_score(parts: Sequence[Column], least: float = 0.05) -> Column:
    """Geometric mean of sub-scores, each kept in [least, 1]."""
    logs = [F.log(clip(p, least, 1.0)) for p in parts]
    return F.exp(sum(logs[1:], logs[0]) / float(len(logs)))


def unit_envelope(area: Column) -> Column:
    return 5.0 * F.pow(area / 184.0, F.lit(0.75))


def travel_time(length_km: Column, slope: Column) -> Column:
    return 0.3 * F.pow(length_km / F.pow(slope, F.lit(0.25)), F.lit(0.76))


def stream_velocity(slope: Column, area: Column, k: float, lo: float, hi: float) -> Column:
    return clip(k * F.sqrt(slope) * F.pow(area, F.lit(0.2)), lo, hi)


def storage_level(volume: Column, a: Num, b: Num, h0: Num) -> Column:
    """Inverse of volume = a (level - h0) ** b."""
    return col(h0) + F.pow(F.greatest(volume, F.lit(0.0)) / col(a), 1.0 / col(b))


def spill_capacity(head: Column, c: Column) -> Column:
    """Null where the weir is unknown: no limit."""
    return c * F.pow(F.greatest(head, F.lit(0.0)), F.lit(1.5))


def gev_cdf(x: Column, loc: Num, scale: Num, xi: Num) -> Column:
    y, k = (x - col(loc)) / col(scale), col(xi)
    t = F.when(F.abs(k) < 1e-6, F.exp(-y)).otherwise(F.pow(F.greatest(1.0 + k * y, F.lit(0.0)), -1.0 / F.when(F.abs(k) < 1e-6, 1.0).otherwise(k)))
    return F.exp(-t)


def gev_quantile(p: Column, loc: Num, scale: Num, xi: Num) -> Column:
    y, k = -F.log(-F.log(p)), col(xi)
    safe = F.when(F.abs(k) < 1e-6, 1.0).otherwise(k)
    return col(loc) + col(scale) * F.when(F.abs(k) < 1e-6, y).otherwise((F.exp(k * y) - 1.0) / safe)


def return_level(years: Num, loc: Num, scale: Num, xi: Num) -> Column:
    return gev_quantile(1.0 - 1.0 / col(years), loc, scale, xi)


def return_period(x: Column, loc: Num, scale: Num, xi: Num, most: float = 1e5) -> Column:
    f = gev_cdf(x, loc, scale, xi)
    return F.when(f >= 1 - 1 / most, most).otherwise(1.0 / (1.0 - f))


def quantile_map(x: Column, source: Sequence[Num], target: Sequence[Num]) -> Column:
    """The value of `target` as rare as x is in `source`; both are (loc, scale, xi)."""
    return gev_quantile(clip(gev_cdf(x, *source), 0.02, 1 - 1 / 2000), *target)


def interpolate(x: Column, xs: Sequence[float], ys: Sequence[float], log: bool = False, extend: bool = False) -> Column:
    """Piecewise linear through given points; constant beyond them, or along the outer pieces. log: on both axes."""
    f = (lambda v: F.log(v)) if log else (lambda v: v)
    g = (lambda v: F.log(F.lit(float(v)))) if log else (lambda v: F.lit(float(v)))
    pieces = []
    for k in range(len(xs) - 1):
        slope = (g(ys[k + 1]) - g(ys[k])) / (g(xs[k + 1]) - g(xs[k]))
        pieces.append(g(ys[k]) + (f(x) - g(xs[k])) * slope)
    out = pieces[-1] if extend else F.when(x >= xs[-1], g(ys[-1])).otherwise(pieces[-1])
    for k in range(len(xs) - 2, 0, -1):
        out = F.when(x < xs[k], pieces[k - 1]).otherwise(out)
    if not extend:
        out = F.when(x <= xs[0], g(ys[0])).otherwise(out)
    return F.exp(out) if log else out


def day_of_leap_year(day: Column) -> Column:
    """1 to 366: March 1 is always the 61st day."""
    leap = F.dayofmonth(F.last_day(F.make_date(F.year(day), F.lit(2), F.lit(1)))) == 29
    return F.dayofyear(day) + F.when((F.month(day) > 2) & ~leap, 1).otherwise(0)


def circular_distance(a: Column, b: Column, period: int = 366) -> Column:
    d = F.abs(a - b)
    return F.least(d, period - d)


def stratum(x: Column, edges: Sequence[float]) -> Column:
    """How many of the rising edges x exceeds or, for the first, reaches."""
    out = F.lit(0)
    for e in edges:
        out = out + F.when(x >= e, 1).otherwise(0)
    return F.when(x.isNull(), None).otherwise(out)


def parse_number(text: Column) -> Column:
    """Numbers as people write them: `12,3`, `1.234,5`, `1,234.5`; `-` and empty text are null."""
    t = F.regexp_replace(F.trim(text), r"\s|[^0-9,.+-]", "")
    decimal_comma = t.rlike(r",\d*$") & ~t.rlike(r",.*\.")
    plain = F.when(decimal_comma & ~t.rlike(r",.*,"), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def fold_text(text: Column) -> Column:
    """Search key: lower case, without accents, one space between words."""
    plain = F.translate(F.lower(text), "áàâäãéèêëíìîïóòôöõúùûüñç", "aaaaaeeeeiiiiooooouuuunc")
    return F.trim(F.regexp_replace(plain, r"[^a-z0-9]+", " "))


def accumulation_parameter(text: Column) -> Column:
    """struct(hours, value) of a phrase such as "accumulated in 12 hours: 80 mm"."""
    hours = F.regexp_extract(text, r"(?i)(\d+)\s*(?:h\b|hours?|horas?)", 1).try_cast("int")
    value = parse_number(F.regexp_extract(text, r"(?i):\s*([\d.,]+)\s*mm", 1))
    return F.struct(hours.alias("hours"), value.alias("value"))


def parse_time(text: Column, formats: Sequence[str] = ("yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "dd/MM/yyyy HH:mm", "yyyyMMddHHmm")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def local_to_utc(t: Column, zone: str = "Europe/Madrid") -> Column:
    return F.to_utc_timestamp(t, zone)


# Codecs of one byte: 255 means unknown.
def code_probability(p: Column) -> Column:
    return F.when(p.isNull(), 255).otherwise(F.floor(clip(p, 0.0, 1.0) * 200.0 + 1e-6)).cast("int")


def decode_probability(code: Column) -> Column:
    return F.when(code == 255, None).otherwise(code / 200.0)


def code_mm(mm: Column) -> Column:
    return F.when(mm.isNull(), 255).otherwise(F.least(F.rint(8.0 * F.sqrt(F.greatest(mm, F.lit(0.0)))), F.lit(254.0))).cast("int")


def decode_mm(code: Column) -> Column:
    return F.when(code == 255, None).otherwise(F.pow(code / 8.0, F.lit(2.0)))


def lead_class(horizon: Column, lead_h: Column) -> Column:
    """Class of lead time of a frame, by its end in hours from now."""
    now = F.when(lead_h <= 2, "h1-2").when(lead_h <= 4, "h3-4").otherwise("h5-6")
    mid = F.when(lead_h <= 30, "d1").otherwise("d2")
    return F.when(horizon == "now", now).when(horizon == "mid", mid).otherwise(F.when(lead_h <= 96, "d2-3").when(lead_h <= 144, "d4-5").otherwise("d6-7"))


def standardised(x: Column, mean: Column, sd: Column) -> Column:
    """Standardised anomaly; null without spread."""
    return (x - mean) / F.nullif(sd, F.lit(0.0))
