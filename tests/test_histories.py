"""Histories over several batches equal those of all readings at once; silent keys are forgotten."""

import random
import time

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.streaming import histories as H
from tessera.streaming import operators as S

HOUR = 3600


def plain(readings, keep=48, series=12, back=3):
    """readings: (seconds, value) of one key."""
    hours = {}
    for t, v in readings:
        hours[t // HOUR] = max(hours.get(t // HOUR, (t, v)), (t, v))
    top = max(hours)
    held = [(h, *hours[h]) for h in sorted(hours) if h > top - keep]
    recent = [(t, v) for h, t, v in held if h > top - series]
    old = [x for x in recent if x[0] <= recent[-1][0] - back * HOUR]
    t0, v0 = (old or recent)[-1 if old else 0]
    t1, v1 = recent[-1]
    return len(held), v1, [(t * 1_000_000, v) for t, v in recent], (v1 - v0) / (t1 - t0) * HOUR if t1 - t0 >= HOUR else None


def run(spark, df, tmp_path):
    with H.state_on_disk(spark):
        S.run_once(df, "update", str(tmp_path / "out"))
    return spark.read.parquet(str(tmp_path / "out"))


def test_batches_in_any_order_give_the_same_history(spark, tmp_path):
    rng = random.Random(4)
    readings = {k: [(rng.randrange(0, 90 * HOUR), float(rng.randrange(100))) for _ in range(60)] for k in range(5)}
    rows = [(k, t, v) for k, own in readings.items() for t, v in own]
    rng.shuffle(rows)
    for n, at in enumerate(range(0, len(rows), 70)):
        part = spark.createDataFrame(rows[at : at + 70] + rows[:3] + [(1, None, 1.0), (2, 5, None)], "k long, t long, v double").withColumn("ts", F.timestamp_seconds("t")).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "in"))
    stream = S.event_time(S.read_files(spark, str(tmp_path / "in"), 1), "ts", "40 days")
    out = run(spark, H.histories(stream, ["k"], "ts", "v"), tmp_path)
    assert out.select("v").distinct().count() >= 4
    for r in out.withColumn("b", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v")))).where("b = 1").collect():
        n, last, series, rate = plain(readings[r.k])
        assert (r.n, r["last"], [tuple(x) for x in r.series], r.gone) == (n, last, series, False)
        assert (r.rate is None) == (rate is None) and (rate is None or abs(r.rate - rate) < 1e-9)


def test_a_silent_key_is_forgotten(spark, tmp_path):
    for part in ([(1, 0, 5.0), (2, 0, 1.0)], [(2, 100 * HOUR, 2.0)], [(2, 101 * HOUR, 3.0)], [(1, 102 * HOUR, 7.0)]):
        spark.createDataFrame(part, "k long, t long, v double").withColumn("ts", F.timestamp_seconds(F.col("t") + 1000 * HOUR)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)  # files come in the order of their times
    stream = S.event_time(S.read_files(spark, str(tmp_path / "in"), 1), "ts", "1 hour")
    rows = sorted((r.k, r.v, r.n, r["last"], r.gone) for r in run(spark, H.histories(stream, ["k"], "ts", "v"), tmp_path).collect())
    assert [(k, n, last, gone) for k, _, n, last, gone in rows if k == 1] == [(1, 1, 5.0, False), (1, 1, 5.0, True), (1, 1, 7.0, False)]


def test_a_batch_of_a_key_is_a_few_messages_to_its_state():
    class Value:
        kept, asked = None, 0

        def get(self):
            self.asked += 1
            return self.kept

        def update(self, value):
            self.asked, self.kept = self.asked + 1, value

    class Handle:
        value, timers = Value(), []

        def getValueState(self, name, schema):  # noqa: N802
            return self.value

        def listTimers(self):  # noqa: N802
            return iter(self.timers)

        def registerTimer(self, at):  # noqa: N802
            self.timers.append(at)

        def deleteTimer(self, at):  # noqa: N802
            self.timers.remove(at)

    one = H.History(["k"], 48, 12, 3)
    one.init(handle := Handle())
    readings = [(k * HOUR // 2, float(k % 7)) for k in range(300)]
    for part in (readings[200:], readings[:200]):
        (row,) = one.handleInputRows((5,), iter([{"t__": t * 1_000_000, "v__": v} for t, v in part]), None)
    assert handle.value.asked == 4 and len(handle.timers) == 1
    n, last, series, change = plain(readings)
    assert (row.k, row.n, row["last"], [tuple(x) for x in row.series], row.rate, row.gone) == (5, n, last, series, change, False)
