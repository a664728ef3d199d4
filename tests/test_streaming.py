import json
import os
from datetime import datetime, timedelta

from manualake.streaming.sightings import Sightings, fold_plates, fold_sightings, stream_sightings

T0 = datetime(2024, 1, 1)
FRAMES = [("s", 0, "a", 80), ("s", 2, "a", 70), ("s", 3, "b", 95), ("s", 20, None, 0), ("s", 21, "a", 80), ("t", 0, "b", 50)]
SHOWN = {("s", 2, "a", 2, 80), ("s", 3, "a", 2, 80), ("s", 3, "b", 1, 95)}


def test_time_to_live_and_pauses():
    s = Sightings()
    assert s.frame(0, [("a", 80)]) == []
    assert s.frame(9, [("a", 80)]) == [("a", 2, 80)]  # no frame in between: it keeps counting
    assert s.frame(20, []) == []
    assert s.frame(21, [("a", 80)]) == []
    assert s.frame(22, [("a", 92), ("b", 93)]) == [("b", 1, 93), ("a", 2, 92)]


def _shown(rows):
    return {(r.session, round((r.ts.replace(tzinfo=None) - T0).total_seconds()), r.key, r.times, r.confidence) for r in rows}


def test_batch_fold(spark):
    rows = [(s, T0 + timedelta(seconds=t), k, c) for s, t, k, c in FRAMES]
    assert _shown(fold_sightings(spark.createDataFrame(rows, "session string, ts timestamp, key string, confidence int")).collect()) == SHOWN


def test_stream_fold_keeps_state(spark, tmp_path):
    source, sink = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    for i, part in enumerate((FRAMES[:1], FRAMES[1:])):
        lines = [json.dumps({"session": s, "ts": str(T0 + timedelta(seconds=t)), "key": k, "confidence": c}) for s, t, k, c in part]
        (source / f"{i}.json").write_text("\n".join(lines))
        os.utime(source / f"{i}.json", (1_000_000 + i * 100,) * 2)  # files are taken by age
    hits = spark.readStream.schema("session string, ts timestamp, key string, confidence int").option("maxFilesPerTrigger", 1).json(str(source))
    run = stream_sightings(hits).writeStream.format("parquet").option("path", str(sink)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None
    assert _shown(spark.read.parquet(str(sink)).collect()) == SHOWN


def test_photos_taps_and_late_tables():
    s = Sightings(live=75, photo=60)
    assert s.event("photo", 0, []) == ([], False)
    assert s.event("again", 1, [("a", 59)]) == ([], False)  # still nothing
    assert s.event("again", 2, [("a", 61)]) == ([("a", 1, 61)], False)
    assert s.event("live", 10, [("b", 99)]) == ([("a", 1, 61)], False)  # the photo stays for its time
    assert s.event("live", 23, []) == ([("a", 1, 61)], False)  # and until a frame has a hit
    assert s.event("live", 24, [("b", 99)]) == ([("b", 1, 99)], True)
    assert s.event("live", 25, [("b", 99)]) == ([("b", 2, 99)], False)  # opens once
    assert s.event("tap", 26, []) == ([], False) and not s.seen
    t = Sightings()
    t.load(s.dump())
    assert t.opened and t.shown == []


def test_plates(spark):
    # (seconds, plate, code, serial)
    rows = [(0, True, "A", None), (5, True, None, "1"), (6, True, "A", "2"), (8, True, "B", None), (90, True, None, "3"), (100, False, None, None), (130, False, None, None), (131, True, "B", "4"), (200, True, None, None)]
    df = spark.createDataFrame([("s", T0 + timedelta(seconds=t), p, c, n) for t, p, c, n in rows], "session string, ts timestamp, is_plate boolean, code string, serial string")
    got = sorted((r.plate, r.code, r.serial) for r in fold_plates(df).collect())
    # A pause of 82 s without frames ends nothing; a frame without a plate 40 s after the last one does.
    assert got == [(1, "A", "1"), (2, "B", "3"), (3, "B", "4")]
    assert fold_plates(df.limit(0)).count() == 0
