"""Majority events over a stream against the batch operator: shuffled and late frames, a handed-over state, a restart from a checkpoint."""

import glob
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lattica.operators import windows
from lattica.streaming import frames as st

SCHEMA = "cell int, frame int, lipid_nr int, ts timestamp"


def occupancy(seed, n=40, cells=3):
    rng = random.Random(seed)
    return [(c, f, rng.choice([-1, 1, 1, 1, 2, 2])) for c in range(cells) for f in range(n) if rng.random() < 0.95 or f == n - 1]


def feed(spark, folder, rows):
    df = spark.createDataFrame(rows, "cell int, frame int, lipid_nr int").withColumn("ts", F.timestamp_seconds(F.col("frame").cast("long") + 1_000_000))
    df.coalesce(1).write.mode("append").parquet(folder)


def run(stream, at):
    q = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{at}/out").collect()]


@pytest.fixture
def place(tmp_path):
    return f"{tmp_path}/{uuid.uuid4().hex}"


def closed(spark, rows, r):
    return sorted(map(tuple, windows.majority_events(spark.createDataFrame(rows, "cell int, frame int, lipid_nr int"), r, dump=False).collect()))


def test_shuffled_batches_restarts_and_late_rows(spark, place):
    rows = occupancy(1)
    random.Random(2).shuffle(rows)
    folder = f"{place}/in"
    cuts = [[x for x in rows if x[1] < 15], [x for x in rows if 15 <= x[1] < 28], [x for x in rows if x[1] >= 28]]
    got = []
    for part in cuts:  # each a run of its own, from the checkpoint of the one before
        feed(spark, folder, part)
        stream = st.majority_changes_stream(spark.readStream.schema(SCHEMA).parquet(folder), 2)
        got = run(stream, place)
    assert sorted(x[:-1] for x in got) == closed(spark, rows, 2) and all(x[-1] == 0 for x in got)
    feed(spark, folder, [(0, 3, 7), (0, 4, 7), (2, 5, 7)])
    got = run(st.majority_changes_stream(spark.readStream.schema(SCHEMA).parquet(folder), 2), place)
    assert sorted((x[0], x[-1]) for x in got if x[-1]) == [(0, 2), (2, 1)]
    assert sorted(x[:-1] for x in got if not x[-1]) == closed(spark, rows, 2)


def test_a_stream_goes_on_from_a_batch_run(spark, place):
    rows = occupancy(3)
    before, after = [x for x in rows if x[1] < 20], [x for x in rows if x[1] >= 20]
    table = spark.createDataFrame(before, "cell int, frame int, lipid_nr int")
    held = st.held_state(table, 2)
    feed(spark, f"{place}/in", after)
    got = run(st.majority_events_stream(spark.readStream.schema(SCHEMA).parquet(f"{place}/in"), 2, held=held), place)
    last = max(f for _, f, _ in rows)
    still = {tuple(x) for x in windows.majority_events(table, 2).collect() if x["bind_f"] < max(f for c, f, _ in before if c == x["cell"])}
    want = {x for x in closed(spark, rows, 2) if x[3] < last}
    assert set(got) == want - still


def test_the_query_takes_its_frames_in_bounded_batches(spark, small, monkeypatch):
    from lattica.plans import streams
    from lattica.plans.fixtures import Fixture

    monkeypatch.setattr(streams, "FRAMES", 40)
    written, table = [], streams.run_to_table
    monkeypatch.setattr(streams, "run_to_table", lambda stream, folder: (written.extend(p for p in glob.glob(f"{folder.removeprefix('file://')}/frames-*/*.parquet")), table(stream, folder))[1])
    before = set(glob.glob(f"{streams.shared(Fixture(spark, small)).removeprefix('file://')}/frames-*/*.parquet"))
    got = streams.st1_majority_events_stream(Fixture(spark, small))
    files = set(written) - before
    frames = [spark.read.parquet(f"file://{f}").select("frame").distinct().count() for f in files]
    assert len(files) == 4 and max(frames) <= 40 and sum(frames) == 150
    want = windows.majority_events(Fixture(spark, small).occupancy, 2, dump=False)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
