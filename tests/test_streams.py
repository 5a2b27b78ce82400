"""Streams with state across a restart."""

import json

from strandline.streaming import unlocked


def test_unlocked_goes_on_after_a_restart(spark, tmp_path):
    for k, v in unlocked.STORE.items():
        spark.conf.set(k, v)
    schema = "user STRING, at LONG, action STRING, body STRING"
    out: dict = {}

    def run():
        stream = unlocked.unlocked(spark.readStream.schema(schema).json(str(tmp_path / "in")))
        keep = lambda df, _: out.update({r.user: (r.unlocked, r.n_events) for r in df.collect()})
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        query.awaitTermination(120)

    def events(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))

    events([("a", 1, "toggle", "7"), ("a", 2, "toggle", "1"), ("b", 1, "load", None), ("c", 1, "save", "[broken"), ("d", 1, "save", json.dumps(["4", 5])), ("e", 1, "save", '{"x": 1}')])
    run()
    assert out == {"a": (["7"], 2), "b": (["1"], 1), "c": (["1"], 1), "d": (["4", "5"], 1), "e": (["1"], 1)}
    out.clear()
    events([("a", 3, "toggle", "9"), ("a", 5, "toggle", "7"), ("d", 2, "toggle", "4"), ("f", 1, "toggle", None)])
    run()
    assert out == {"a": (["9"], 4), "d": (["5"], 2), "f": (["1"], 1)}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
