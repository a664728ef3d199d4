"""Sightings of hits and plates over frames: one fold, run over stored frames or as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

SHOWN = "session string, ts timestamp, key string, times int, confidence int, opens boolean"
#: Seconds that a hit, a photo's hits and a plate stay; sightings and confidence that show a hit; least
#: confidence in a live frame and in a photo; hits shown at most.
HIT_STAYS, PHOTO_STAYS, PLATE_STAYS = 8.0, 20.0, 30.0
CONFIRMED, CERTAIN, LIVE, PHOTO, TOP = 2, 92, 75, 60, 8


class Sightings:
    """Of each hit how often, how surely and when last it was seen, and what is shown of that.

    After each live frame hits not seen for `stays` seconds go; there is no timer, so a hit seen again after a longer
    pause without frames keeps counting. Shown are hits seen `times` times or with a confidence of `sure`, the best
    `limit`. A photo's hits replace all; live frames are left alone until it has been shown for its time, and then
    until one has a hit of its own. A tap clears everything. A photo that found nothing is read again when the
    reference table arrives. One sure hit that is shown alone opens once.
    """

    def __init__(self, *, stays: float = HIT_STAYS, times: int = CONFIRMED, sure: int = CERTAIN, limit: int = TOP, live: int = 0, photo: int = 0):
        self.stays, self.times, self.sure, self.limit, self.least = stays, times, sure, limit, {"live": live, "photo": photo, "again": photo}
        self.seen: dict[str, tuple[int, int, float]] = {}
        self.shown: list[tuple[str, int, int]] = []
        self.until, self.from_photo, self.opened, self.pending = 0.0, False, False, False

    def _best(self, hits: Iterable[tuple[str, int]], least: int) -> dict[str, int]:
        best: dict[str, int] = {}
        for key, confidence in hits:
            if confidence >= least:
                best[key] = max(best.get(key, 0), confidence)
        return best

    def _top(self, shown: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        return sorted(shown, key=lambda x: (-x[2], x[0]))[: self.limit]

    def frame(self, at: float, hits: Iterable[tuple[str, int]]) -> list[tuple[str, int, int]]:
        """What is shown after a live frame."""
        found = self._best(hits, self.least["live"])
        if self.from_photo and (at < self.until or not found):
            return self.shown
        self.from_photo = False
        for key, confidence in found.items():
            n, known, _ = self.seen.get(key, (0, 0, at))
            self.seen[key] = (n + 1, max(known, confidence), at)
        self.seen = {k: v for k, v in self.seen.items() if at - v[2] <= self.stays}
        self.shown = self._top((k, n, c) for k, (n, c, _) in self.seen.items() if n >= self.times or c >= self.sure)
        return self.shown

    def picture(self, at: float, hits: Iterable[tuple[str, int]]) -> list[tuple[str, int, int]]:
        """What is shown after a photo."""
        self.shown = self._top((k, 1, c) for k, c in self._best(hits, self.least["photo"]).items())
        self.seen, self.from_photo, self.until, self.pending = {}, True, at + PHOTO_STAYS, not self.shown
        return self.shown

    def again(self, at: float, hits: Iterable[tuple[str, int]]) -> list[tuple[str, int, int]]:
        """What is shown when the last photo, which found nothing, is read with the table that has arrived."""
        found = list(hits)
        return self.picture(at, found) if self.pending and not self.shown and self._best(found, self.least["again"]) else self.shown

    def tap(self) -> list[tuple[str, int, int]]:
        self.seen, self.shown, self.from_photo, self.until, self.pending = {}, [], False, 0.0, False
        return self.shown

    def event(self, kind: str, at: float, hits: list[tuple[str, int]]) -> tuple[list[tuple[str, int, int]], bool]:
        """What is shown after an event, and whether its one hit opens."""
        shown = self.tap() if kind == "tap" else getattr(self, {"photo": "picture", "again": "again"}.get(kind, "frame"))(at, hits)
        opens = kind == "live" and not self.opened and len(shown) == 1 and shown[0][2] >= self.sure
        self.opened = self.opened or opens
        return shown, opens

    def dump(self) -> str:
        return json.dumps([self.seen, self.shown, self.until, self.from_photo, self.opened, self.pending])

    def load(self, text: str) -> None:
        seen, shown, self.until, self.from_photo, self.opened, self.pending = json.loads(text)
        self.seen, self.shown = {k: tuple(v) for k, v in seen.items()}, [tuple(x) for x in shown]


def _fold(state: Sightings, ts: list, kinds: list[str | None], keys: list[str | None], confidences: list[int | None]) -> Iterator[tuple]:
    """(ts, key, times, confidence, opens) whenever what is shown changes. Rows come in order of time and kind."""
    i = 0
    while i < len(ts):
        j = i
        while j < len(ts) and ts[j] == ts[i] and kinds[j] == kinds[i]:
            j += 1
        before = state.shown
        hits = [(keys[k], int(confidences[k])) for k in range(i, j) if keys[k] is not None and confidences[k] is not None]
        shown, opens = state.event(kinds[i] or "live", ts[i].timestamp(), hits)
        if shown != before:
            yield from ((ts[i], key, n, c, opens) for key, n, c in shown)
        i = j


def _frames(hits: DataFrame) -> DataFrame:
    """One row a session, time, kind and key, its best confidence: combined before the shuffle."""
    kind = F.coalesce("kind", F.lit("live")) if "kind" in hits.columns else F.lit("live")
    rows = hits.filter("session is not null and ts is not null").select("session", "ts", kind.alias("kind"), "key", "confidence")
    return rows.groupBy("session", "ts", "kind", "key").agg(F.max("confidence").cast("int").alias("confidence"))


def fold_sightings(hits: DataFrame, *, live: int = 0, photo: int = 0) -> DataFrame:
    """What is shown whenever that changes, over frames (session, ts, key, confidence, and kind: live, photo, again or
    tap, where there is one) in batch; a null key is a frame without hits.

    A session is folded in order by one task; sessions are bounded by their frames, not by the data."""
    types = [pa.string(), pa.timestamp("us", tz="UTC"), pa.string(), pa.int32(), pa.int32(), pa.bool_()]
    names = [x.split()[0] for x in SHOWN.split(", ")]

    def fold(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("ts", "ascending"), ("kind", "ascending"), ("key", "ascending")])
        out = list(_fold(Sightings(live=live, photo=photo), *(rows.column(c).to_pylist() for c in ("ts", "kind", "key", "confidence"))))
        cols = [[key[0].as_py()] * len(out), *(list(zip(*out)) if out else [()] * 5)]
        return pa.table([pa.array(c, t) for c, t in zip(cols, types)], names=names)

    return _frames(hits).groupBy("session").applyInArrow(fold, SHOWN)


def stream_sightings(hits: DataFrame, *, watermark: str = "1 minute", live: int = 0, photo: int = 0) -> DataFrame:
    """The same of a stream of hits, the state of each session kept between micro-batches.

    The watermark, an extension, bounds the state: hits later than it are dropped by Spark, idle sessions end."""
    columns = [x.split()[0] for x in SHOWN.split(", ")]

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=columns)
            return
        seen = Sightings(live=live, photo=photo)
        if state.exists:
            seen.load(state.get[0])
        frames = pd.concat(list(batches)).sort_values(["ts", "kind", "key"], kind="stable")
        known = [[None if x is None or x != x else x for x in frames[c].tolist()] for c in ("kind", "key", "confidence")]
        yield pd.DataFrame([(key[0], *row) for row in _fold(seen, frames["ts"].tolist(), *known)], columns=columns)
        state.update((seen.dump(),))
        state.setTimeoutTimestamp(int(max(state.getCurrentWatermarkMs(), frames["ts"].max().timestamp() * 1000)) + 60_000)

    kind = F.coalesce("kind", F.lit("live")) if "kind" in hits.columns else F.lit("live")
    rows = hits.filter("session is not null and ts is not null").select("session", "ts", kind.alias("kind"), "key", "confidence")
    return rows.withWatermark("ts", watermark).groupBy("session").applyInPandasWithState(fold, SHOWN, "state string", "append", GroupStateTimeout.EventTimeTimeout)


def fold_plates(frames: DataFrame, *, stays: float = PLATE_STAYS, fields: tuple[str, ...] = ("code", "serial")) -> DataFrame:
    """Plates (session, plate, fields, first, last) accumulated from frames (session, ts, is_plate, fields).

    Fields keep their first value that is not empty. Another code begins a new plate; so does the first plate frame
    after a frame without a plate more than `stays` seconds after the last one with it: a pause without any frame ends
    no plate. Plates of which nothing was read are left out.
    """
    filled = [F.nullif(c, F.lit("")).alias(c) for c in fields]
    rows = frames.select("session", F.col("ts").cast("double").alias("_t"), "ts", F.coalesce("is_plate", F.lit(False)).alias("is_plate"), *filled)
    order = Window.partitionBy("session").orderBy("ts", F.col("is_plate").desc(), *fields)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    seen, gone = F.last(F.when(F.col("is_plate"), F.col("_t")), ignorenulls=True).over(before), F.last(F.when(~F.col("is_plate"), F.col("_t")), ignorenulls=True).over(before)
    rows = rows.withColumn("_fresh", F.col("is_plate") & (seen.isNull() | F.coalesce(gone - seen > stays, F.lit(False)))).withColumn("_e", F.sum(F.col("_fresh").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    within = Window.partitionBy("session", "_e").orderBy("ts", *fields)
    rows = rows.filter("is_plate").withColumn("_known", F.last("code", ignorenulls=True).over(within.rowsBetween(Window.unboundedPreceding, -1)))
    starts = (F.coalesce(F.col("code") != F.col("_known"), F.lit(False)) | F.col("_fresh")).cast("int")
    rows = rows.withColumn("_s", starts).withColumn("plate", F.sum("_s").over(Window.partitionBy("session").orderBy("ts", F.desc("_fresh"), *fields).rowsBetween(Window.unboundedPreceding, 0)))

    def first(c: str) -> Column:
        return F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("ts", c))).alias(c)

    out = rows.groupBy("session", "plate").agg(*[first(c) for c in fields], F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.filter(F.coalesce(*fields).isNotNull())
