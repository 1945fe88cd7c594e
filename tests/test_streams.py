"""Chains as keyed state and the polled feed: whatever the batches, and over restarts."""

import json
import random
import time

import pytest

from pyspark.sql.types import StructType

from millrace.operators import records
from millrace.sources import feed
from millrace.streaming import chains

RECORDS = "stream_id string, seq long, prev string, own string"


def write(spark, rows, folder):
    spark.createDataFrame(rows, RECORDS).coalesce(1).write.mode("append").json(str(folder))


def run(spark, tmp_path, batches, patience_ms, until=None):
    """All batches through one query, stopped and begun again in the middle; ``until``: faults to wait for after each batch."""
    seen, source = [], tmp_path / "in"
    source.mkdir(parents=True)
    start = lambda: chains.run_chains(spark.readStream.schema(RECORDS).json(str(source)), str(tmp_path / "ck"), lambda df: seen.extend(map(tuple, df.collect())), patience_ms)
    query = start()
    try:
        for k, rows in enumerate(batches):
            write(spark, rows, source)
            # a query with timers always has a next batch, so what it took is waited for
            end, since = time.time() + 40, 0 if k < 2 else sum(map(len, batches[1:k]))
            while time.time() < end and (sum(p["numInputRows"] for p in query.recentProgress) < since + len(rows) or (until and len(seen) < until[k])):
                time.sleep(0.2)
            if k == 0:
                query.stop()
                query = start()
    finally:
        query.stop()
    return sorted(seen)


def test_faults_do_not_hang_on_the_batches(spark, tmp_path):
    own = lambda s, k: f"{s}{k}"
    rows = [(s, k, own(s, k - 1) if k else None, own(s, k)) for s in "ab" for k in range(12)]
    rows[5] = ("a", 5, "wrong", "a5")
    rows += [("a", 7, "a6", "a7"), ("b", 3, "b2", "other"), ("b", 11, "b10", "b11")]
    want = [("a", 5, "link"), ("a", 7, "repeat"), ("b", 3, "fork"), ("b", 11, "repeat")]
    first, rest = rows[:-3], rows[-3:]
    for k in range(2):
        random.Random(k).shuffle(first)
        cut = [first[:9], first[9:], rest] if k else [first, rest]
        got = run(spark, tmp_path / str(k), cut, 3_600_000)
        assert got == sorted(want)


def test_what_does_not_come_is_given_up_and_late_then(spark, tmp_path):
    rows = lambda *seqs: [("a", k, f"a{k - 1}", f"a{k}") for k in seqs]
    batches = [[("a", 0, None, "a0"), ("b", 2, "b1", "b2")], rows(2, 3, 6), rows(1, 7)]
    got = run(spark, tmp_path, batches, 0, until=[1, 3, 4])
    assert got == [("a", 1, "late"), ("a", 2, "gap"), ("a", 6, "gap"), ("b", 2, "start")]


def test_late_records_of_a_batch(spark):
    heads = spark.createDataFrame([("s", 5, "h5", 6)], "stream string, seq long, digest string, n long")
    more = spark.createDataFrame([("s", k) for k in (2, 3, 5, 6, 8)], "stream string, seq long")
    got = sorted((r.seq, r.fault) for r in records.chain_faults(more, "stream", "seq", heads=heads).collect())
    assert got == [(2, "late"), (3, "late"), (5, "repeat"), (8, "gap")]


def person(k, texted=""):
    return {"name": f"N{k}", "email": f"P{k}@x.co ", "phone": f"+1{k}", "ts": str(k), "texted_at": texted}


def test_acts_are_done_at_least_once_and_then_marked(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    put = lambda n, rows: (folder / f"{n:03}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    put(1, [person(1), person(2), person(3, "old"), {"name": "no phone", "email": "q@x.co"}])
    done = []
    act = lambda df: done.append(sorted(r.email.strip() for r in df.collect()))

    def broken(df, at):
        raise RuntimeError("ended between act and mark")

    start = lambda **more: feed.run_acts(feed.feed_stream(spark, str(folder)), str(tmp_path / "marks"), str(tmp_path / "ck"), act, **more).awaitTermination()
    with pytest.raises(Exception, match="ended between"):
        start(mark=broken)
    assert done == [["P1@x.co", "P2@x.co"]]
    start()
    assert done == [["P1@x.co", "P2@x.co"]] * 2  # again, and marked now
    put(2, [person(2), person(4)])
    put(3, [person(1), person(4), person(5)])
    start()
    assert done[2:] == [["P4@x.co", "P5@x.co"]]
    start()
    assert done[3:] in ([], [[]])


def test_a_batch_run_again_after_its_mark_changes_nothing(spark, tmp_path):
    folder = tmp_path / "feed"
    folder.mkdir()
    (folder / "1.json").write_text(json.dumps(person(1)) + "\n")
    done = []

    def marks_and_ends(df, at):
        df.write.mode("append").parquet(at)
        raise RuntimeError("ended after the mark")

    start = lambda **more: feed.run_acts(feed.feed_stream(spark, str(folder)), str(tmp_path / "marks"), str(tmp_path / "ck"), lambda df: done.append(df.count()), **more).awaitTermination()
    with pytest.raises(Exception, match="ended after"):
        start(mark=marks_and_ends)
    start()
    assert done == [1, 0] and spark.read.parquet(str(tmp_path / "marks/*")).count() == 1


def test_feed_partitions_by_files(tmp_path):
    for k in range(40):
        (tmp_path / f"{k:03}.json").write_text("{}\n")
    reader = feed._Reader(str(tmp_path), StructType([]), 16)
    assert reader.latestOffset() == {"last": "039.json"}
    assert [len(p.files) for p in reader.partitions({"last": "004.json"}, {"last": "039.json"})] == [16, 16, 3]
