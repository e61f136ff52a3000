"""Chat formatting: each dialogue once from the view of each of its speakers.

In a perspective the speaker's own turns are the assistant's, to be learned; all others are turns of named users. Turns
of the context roles (system) belong to nobody: they stay as they are in every perspective, and are never learned. All
steps are native DataFrame functions.

A turn is rendered as `<|im_start|>ROLE\\nCONTENT<|im_end|>\\n`, ROLE being assistant, a context role, or user name=NAME.
`<|` in a content or a name becomes `<\\u200b|`, so that no text can open or close a turn. A learned span covers a content
and its end mark.

A dialogue's turns meet once, as a set that is begun before the shuffle, so that neither repeated rows nor a text in several
views is moved more than once; all views are put together from it in place. They are so in runs of `run` turns, which keeps
the running sums of lengths short. A dialogue is one row of its output, however long; texts too long for one row can be
had in segments instead (per_segment), each of which stands for itself.

Rows with a null conv_id or turn belong to no dialogue. Repeated rows count once; different rows of one turn are ordered
by role, then text. A null or empty role is the speaker "unknown", a null text is empty. A dialogue of context turns only
has no perspective, so no rows; nor has an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import attach

CONTEXT = ("system",)


def perspectives(turns: DataFrame, context: tuple[str, ...] = CONTEXT, per_segment: int | None = None, run: int = 256) -> DataFrame:
    """conv_id, perspective, segment (0 unless per_segment, a number of turns, is given), n_turns, text, spans (array of
    start and stop, in characters of text, of what is learned), n_learned (characters), of conv_id, turn, role, text."""
    plain = turns.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.nullif(F.col("role"), F.lit("")), F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    segment = F.floor(F.col("turn") / per_segment).cast("long") if per_segment else F.lit(0).cast("long")
    rows = plain.withColumn("segment", segment).groupBy("conv_id", "segment").agg(F.sort_array(F.collect_set(F.struct("turn", "role", "text"))).alias("turns"))
    speaks = F.array_distinct(F.transform(F.filter("turns", lambda t: ~t["role"].isin(*context)), lambda t: t["role"]))
    if per_segment:  # whoever speaks anywhere in a dialogue has a view of each of its segments
        speakers = plain.groupBy("conv_id").agg(F.collect_set(F.when(~F.col("role").isin(*context), F.col("role"))).alias("speakers"), F.count_distinct(segment).alias("rows__"))
        rows, speaks = attach(rows, speakers, "conv_id", rows.count()), F.col("speakers")
    shut = lambda c: F.replace(c, F.lit("<|"), F.lit("<\u200b|"))
    label = lambda t: F.when(t["role"].isin(*context), t["role"]).otherwise(F.concat(F.lit("user name="), shut(t["role"])))
    rendered = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), label(t).alias("label"), F.concat(shut(t["text"]), F.lit("<|im_end|>")).alias("body")))
    sized = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["label"].alias("label"), t["body"].alias("body"), F.length(t["label"]).alias("n_label"), F.length(t["body"]).alias("n_body")))
    n = F.size("turns")
    in_runs = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / run).cast("int")), lambda k: F.slice("turns", k * run + 1, F.lit(run)))
    rows = rows.select("conv_id", "segment", speaks.alias("speakers"), rendered.alias("turns")).withColumn("turns", sized)
    seen = rows.select("conv_id", F.explode("speakers").alias("perspective"), "segment", n.cast("long").alias("n_turns"), in_runs.alias("runs"))
    mine = lambda t: t["role"] == F.col("perspective")
    head = lambda t: F.when(mine(t), F.lit("assistant")).otherwise(t["label"])
    n_head = lambda t: F.when(mine(t), F.lit(len("assistant"))).otherwise(t["n_label"])
    # <|im_start|>HEAD, newline, BODY, newline
    open_, ends = len("<|im_start|>"), 2
    total = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + open_ + ends + n_head(t) + t["n_body"])
    text = F.array_join(F.transform("runs", lambda r: F.array_join(F.transform(r, lambda t: F.concat(F.lit("<|im_start|>"), head(t), F.lit("\n"), t["body"], F.lit("\n"))), "")), "")
    sums = seen.withColumns({"text": text, "sizes": F.transform("runs", total)})
    origin = lambda k: F.aggregate(F.slice("sizes", F.lit(1), k), F.lit(0).cast("long"), lambda a, x: a + x)
    placed = F.transform("runs", lambda r, k: F.struct(r.alias("turns"), origin(k).alias("origin")))

    def learned(run_: Column) -> Column:
        at = lambda i: run_["origin"] + total(F.slice(run_["turns"], F.lit(1), i)) + open_ + len("assistant") + 1
        own = F.transform(run_["turns"], lambda t, i: F.when(mine(t), F.struct(at(i).alias("start"), (at(i) + t["n_body"]).alias("stop"))))
        return F.filter(own, lambda s: s.isNotNull())

    out = sums.withColumn("placed", placed).withColumn("spans", F.flatten(F.transform("placed", learned)))
    return out.select("conv_id", "perspective", "segment", "n_turns", "text", "spans", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"]).alias("n_learned"))
