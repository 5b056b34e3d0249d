"""The stream of task states against the fold of its log, and tasks that hang."""

import datetime as dt
import random

from quarrylight.streaming import tasks

KIND = "task string, state string, at long, ts timestamp"


def fold(rows):
    out = {}
    for task in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == task), key=lambda r: r[2])
        ended = [r for r in mine if r[1] in tasks.FINAL]
        out[task] = ended[0][1] if ended else mine[-1][1]
    return out


def test_stream_is_the_fold(spark, tmp_path):
    """Rows in any order, some twice, some very late, a restart between, then silence."""
    rng, start = random.Random(2), dt.datetime(2026, 1, 1)
    rows = [(f"t{rng.randrange(40)}", rng.choice(["pending", *["running"] * 12, "completed", "failed"]), i, start + dt.timedelta(hours=i)) for i in range(300)]
    rng.shuffle(rows)
    late = [r for r in rows if r[2] < 40]

    def deliver(some, name):
        spark.createDataFrame([*some, (None, "x", 1, start), ("none", None, 1, start)], KIND).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
        tasks.start(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", patience=name).awaitTermination()
        return {r["task"]: r["state"] for r in tasks.latest(spark.read.parquet(f"{tmp_path}/out")).collect()}

    first = [r for r in rows if r[2] >= 40]
    assert deliver(first, 3600) == fold(first)
    assert deliver(late + rows[:30], 3600) == fold(rows)
    deliver(rows[:60], 0)
    got, want, heard = deliver([("new", "completed", 999, start)], 0), fold(rows), {r[0] for r in rows[:60]}
    assert all(got[t] == (tasks.HANGING if s not in tasks.FINAL and t in heard else s) for t, s in want.items()) and tasks.HANGING in got.values()
