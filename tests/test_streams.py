"""Running diagnostics of a stream that stops and starts again."""

import random

from rankweave.streaming.rolling import running


def test_state_survives_a_restart(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), i, round(rng.uniform(-5, 5), 3)) for i in range(400)] + [("a", 1000, None), (None, 1001, 1.0)]
    schema = "k string, i long, v double"
    want, seen = {}, {}
    for k, i, v in rows[:400]:
        seen.setdefault(k, []).append(v)
        last = seen[k][-50:]
        want[i] = (k, len(seen[k]), round(sum(last) / len(last), 9), max(seen[k]))
    for part in (rows[:150], rows[150:160], rows[160:]):  # three runs, each from the checkpoint of the one before
        rng.shuffle(part)
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(str(tmp_path / "in"))
        stream = running(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "k", ["i"], "v")
        stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = {r["i"]: (r["k"], r["n"], round(r["mean"], 9), r["best"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == want
