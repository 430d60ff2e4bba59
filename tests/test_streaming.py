import numpy as np

from lexiprint.streaming import profiles as S


def files(spark, tmp_path, rows, schema, parts=3):
    for i in range(parts):
        spark.createDataFrame(rows[i::parts], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_running_profile_ends_at_the_batch_mean(spark, tmp_path):
    r = np.random.default_rng(0)
    rows = [(f"m{i % 3}", i, r.normal(size=4).tolist()) for i in range(60)]
    stream = files(spark, tmp_path, rows, "model string, ts long, vec array<double>")
    got = {(x["model"], x["dim"]): (x["n"], x["mean"]) for x in run(S.running_components(stream), "running", "complete").collect()}
    for m in range(3):
        want = np.mean([v for name, _, v in rows if name == f"m{m}"], axis=0)
        for d in range(4):
            assert got[f"m{m}", d][0] == 20 and abs(got[f"m{m}", d][1] - want[d]) < 1e-9


def test_drift_keeps_the_first_sample_as_baseline(spark, tmp_path):
    rows = [("a", i, [0.01 * i, 0.0]) for i in range(30)]
    stream = files(spark, tmp_path, rows, "model string, ts long, vec array<double>", parts=1)
    got = {x["ts"]: x for x in run(S.drift_stream(stream), "drifting", "append").collect()}
    assert len(got) == 30 and abs(got[20]["drift"] - 0.2) < 1e-9 and got[20]["level"] == "high" and got[3]["level"] == "none"
    assert not any(x["change"] for x in got.values())


def test_features_and_windows(spark, tmp_path):
    stream = files(spark, tmp_path, [(i, "One two three. Four five six? " * 4) for i in range(9)], "doc_id long, text string")
    assert run(S.feature_stream(stream, ["punctuation"]), "features", "append").count() == 9
    import datetime as dt

    ev = [(dt.datetime(2024, 1, 1, i % 24), "k", float(i)) for i in range(48)]
    events = files(spark, tmp_path / "e", ev, "ts timestamp, key string, value double", parts=1)
    got = run(S.windowed(events, late="1 minute"), "windows", "complete").collect()
    assert len(got) == 24 and all(x["n"] == 2 for x in got)
