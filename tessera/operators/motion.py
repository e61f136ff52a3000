"""The motion of a rain field between scans, from sums of gradient products over windows, at one or several scales.

Where a pattern moves, its change in time is minus the motion times its gradient. Over the window around each cell the
motion that fits best has a closed form in five sums of products, which are running sums along both axes. Large motions
are found on block means first; each finer scale moves the earlier scan by what is known and adds what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.storage import durable


def decibels(value: Column, least: float = 0.1, dry: float = -15.0) -> Column:
    """10 log10 of what reaches `least`; `dry` for less, and for what is unknown."""
    return F.when(value >= least, 10.0 * F.log10(value)).otherwise(F.lit(dry))


def _coarse(scans: DataFrame, keys: Sequence[str], t: str, value: str, size: int) -> DataFrame:
    j, i = F.floor(F.col("j") / size).cast("int").alias("j"), F.floor(F.col("i") / size).cast("int").alias("i")
    return scans.groupBy(*keys, t, j, i).agg(F.avg(F.coalesce(value, F.lit(0.0))).alias("m_")).select(*keys, t, "j", "i", decibels(F.col("m_")).alias("z_"))


def _moved(cells: DataFrame, field: DataFrame, keys: Sequence[str], ny: int, nx: int) -> DataFrame:
    """cells (keys, t, j, i, vj, vi) with w_: the field's value at (j - vj, i - vi), bilinear, the edge repeated."""
    inside = lambda c, n: F.least(F.greatest(c, F.lit(0.0)), F.lit(float(n - 1)))
    at = cells.withColumns({"y_": inside(F.col("j") - F.col("vj"), ny), "x_": inside(F.col("i") - F.col("vi"), nx)})
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    part = lambda c, o: F.when(o == 1, c - F.floor(c)).otherwise(1 - (c - F.floor(c)))
    wide = at.withColumn("o_", corner).withColumn("p_", part(F.col("y_"), F.col("o_.a")) * part(F.col("x_"), F.col("o_.b"))).where("p_ > 0")
    wide = wide.withColumns({"sj_": (F.floor("y_") + F.col("o_.a")).cast("int"), "si_": (F.floor("x_") + F.col("o_.b")).cast("int")})
    source = field.select(*keys, F.col("j").alias("sj_"), F.col("i").alias("si_"), "z_")
    return wide.join(source, [*keys, "sj_", "si_"]).groupBy(*keys, "j", "i").agg(F.first("vj").alias("vj"), F.first("vi").alias("vi"), F.sum(F.col("p_") * F.col("z_")).alias("w_"))


def _slope(keys: Sequence[str], axis: str, other: str) -> Column:
    """Half the difference of both neighbours; at an edge the difference to the one neighbour."""
    line = Window.partitionBy(*keys, other).orderBy(axis)
    before, after = F.lag("w_").over(line), F.lead("w_").over(line)
    return F.coalesce((after - before) / 2, after - F.col("w_"), F.col("w_") - before, F.lit(0.0))


def motion(scans: DataFrame, keys: Sequence[str], t: str, value: str, ny: int, nx: int, coarse: int = 2, scales: int = 3, half: int = 8, ridge: float = 1e-2, least_wet: float = 0.002) -> DataFrame:
    """keys, j, i, vj, vi: the motion, in cells for a step of `t`, of each cell of complete fields of ny x nx. scans: keys, t (whole
    steps), j, i, value; neighbouring steps make pairs, and all pairs of a key count alike.

    Block means of coarse, 2 coarse, ... cells, `scales` of them, are looked at from the largest down, in decibels. half: cells of a
    window to each side. ridge: what is added to the sums of squared gradients, as a share of their mean over the key, so
    that windows with little in them keep the motion of the larger scale, which starts from none. Keys whose newest scan is
    wet (over 0.1) in less than least_wet of its cells, or without a pair, do not move. Unknown cells count as dry."""
    now = scans.groupBy(*keys, "j", "i").agg(F.max_by(value, t).alias("last_"), F.countDistinct(t).alias("n_"))
    still = now.groupBy(*keys).agg(((F.avg((F.coalesce("last_", F.lit(0.0)) > 0.1).cast("double")) < least_wet) | (F.max("n_") < 2)).alias("still_"))
    known = None
    for scale in reversed(range(scales)):
        size = coarse << scale
        rows, columns = -(-ny // size), -(-nx // size)
        z = durable(_coarse(scans, keys, t, value, size))
        if known is None:
            cells = z.select(*keys, t, "j", "i", F.lit(0.0).alias("vj"), F.lit(0.0).alias("vi"))
        else:  # from the blocks that are twice as large
            larger = known.select(*keys, F.col("j").alias("bj_"), F.col("i").alias("bi_"), (2 * F.col("vj")).alias("vj"), (2 * F.col("vi")).alias("vi"))
            own = z.select(*keys, t, "j", "i").withColumns({"bj_": F.floor(F.col("j") / 2).cast("int"), "bi_": F.floor(F.col("i") / 2).cast("int")})
            cells = own.join(larger, [*keys, "bj_", "bi_"]).drop("bj_", "bi_")
        earlier = z.withColumn(t, F.col(t) + 1)
        timed = [*keys, t]
        both = _moved(cells, earlier, timed, rows, columns).join(z, [*timed, "j", "i"])
        g = both.withColumns({"gj_": _slope(timed, "j", "i"), "gi_": _slope(timed, "i", "j"), "d_": F.col("z_") - F.col("w_")})
        products = {"jj_": ("gj_", "gj_"), "ji_": ("gj_", "gi_"), "ii_": ("gi_", "gi_"), "jd_": ("gj_", "d_"), "id_": ("gi_", "d_")}
        summed = g.groupBy(*keys, "j", "i").agg(F.first("vj").alias("vj"), F.first("vi").alias("vi"), *[F.sum(F.col(a) * F.col(b)).alias(p) for p, (a, b) in products.items()])
        for axis, other in (("i", "j"), ("j", "i")):
            line = Window.partitionBy(*keys, other).orderBy(axis).rangeBetween(-half, half)
            summed = summed.withColumns({p: F.sum(p).over(line) for p in products})
        strength = summed.groupBy(*keys).agg((F.avg((F.col("jj_") + F.col("ii_")) / 2) * ridge).alias("r_"))
        a, b, c = F.col("jj_") + F.col("r_"), F.col("ji_"), F.col("ii_") + F.col("r_")
        flat = a * c - b * b
        step = lambda x, y: F.when(flat > 0, (x - y) / flat).otherwise(0.0)
        more_j, more_i = step(b * F.col("id_"), c * F.col("jd_")), step(b * F.col("jd_"), a * F.col("id_"))
        known = durable(summed.join(strength, list(keys)).select(*keys, "j", "i", (F.col("vj") + more_j).alias("vj"), (F.col("vi") + more_i).alias("vi")))
    fine = now.join(still, list(keys)).withColumns({"bj_": F.floor(F.col("j") / coarse).cast("int"), "bi_": F.floor(F.col("i") / coarse).cast("int")})
    blocks = known.select(*keys, F.col("j").alias("bj_"), F.col("i").alias("bi_"), "vj", "vi")
    v = lambda c: F.when(F.col("still_"), 0.0).otherwise(F.coalesce(F.col(c) * coarse, F.lit(0.0))).alias(c)
    return fine.join(blocks, [*keys, "bj_", "bi_"], "left").select(*keys, "j", "i", v("vj"), v("vi"))
