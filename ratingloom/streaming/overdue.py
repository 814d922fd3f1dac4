"""Games whose result is overdue: a warning once per wait, taken back when the result or a later kickoff comes.

Events are (game_id, event, noted_at, kickoff). A game without a result is ``overdue`` when ``days`` have passed since its kickoff, or when a
version says so later than that. An overdue game's next version with a result gives ``result``, one with a kickoff whose wait isn't
over (or with none) gives ``rescheduled``, after which the game may become overdue again. A result is final. Versions of one game at one time count as one: a result
before none, then the latest kickoff. Times are compared in milliseconds. Versions without an id or a time of capture are passed over;
a game without a kickoff is never overdue; a missing ``completed`` means no result.

``overdue_events`` is the rule over a table of versions, ``overdue_stream`` the same as keyed state with timers. The stream holds versions
back until the watermark has passed them, so neither the order of arrival within ``delay`` nor the cut into batches changes an event.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.raw_json import schedule_records

DAY_MS = 86_400_000
EVENTS = "game_id bigint, event string, at bigint, kickoff bigint"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _version() -> list[Column]:
    """(game_id, at, done, kickoff) of a version, times in milliseconds."""
    time = {"at": "captured_at", "kickoff": "game_date"}
    ms = {k: F.unix_millis(F.col(v).cast("timestamp")).alias(k) for k, v in time.items()}
    return [F.col("game_id").cast("bigint").alias("game_id"), ms["at"], F.coalesce("completed", F.lit(False)).alias("done"), ms["kickoff"]]


def _as_times(events: DataFrame) -> DataFrame:
    return events.select("game_id", "event", F.timestamp_millis("at").alias("noted_at"), F.timestamp_millis("kickoff").alias("kickoff"))


def overdue_events(versions: DataFrame, days: int, until: str | None = None) -> DataFrame:
    """Events up to ``until``, by default the newest capture, of versions (game_id, captured_at, completed, game_date)."""
    rows = versions.select(*_version()).where("game_id IS NOT NULL AND at IS NOT NULL")
    end = rows.agg(F.max("at").alias("_end")) if until is None else rows.sparkSession.range(1).select(F.unix_millis(F.lit(until).cast("timestamp")).alias("_end"))
    rows = rows.crossJoin(F.broadcast(end)).where("at <= _end")
    rows = rows.groupBy("game_id", "at", "_end").agg(F.max(F.struct("done", "kickoff")).alias("v")).select("game_id", "at", "_end", "v.*")
    game = Window.partitionBy("game_id")
    line = game.orderBy("at")
    rows = rows.withColumns({"_final": F.min(F.when(F.col("done"), F.col("at"))).over(game), "_next": F.lead("at").over(line)})
    due = F.col("kickoff") + days * DAY_MS
    start = F.when(due.isNotNull(), F.greatest(due, "at"))
    late = ~F.col("done") & (start < F.coalesce("_next", F.col("_end") + 1))
    rows = rows.where("_final IS NULL OR at <= _final").withColumns({"_start": start, "_late": F.coalesce(late, F.lit(False)), "_passed": F.coalesce(due <= F.col("at"), F.lit(False))})
    rows = rows.withColumn("_was", F.coalesce(F.lag("_late").over(line), F.lit(False)))

    def event(name: str, when: Column, at: str) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("event"), F.col(at).alias("at")))

    was, passed = F.col("_was"), F.col("_passed")
    found = F.array(
        event("result", was & F.col("done"), "at"), event("rescheduled", was & ~F.col("done") & ~passed, "at"), event("overdue", F.col("_late") & ~(was & passed), "_start")
    )
    return _as_times(rows.select("game_id", "kickoff", F.explode(F.array_compact(found)).alias("e")).select("game_id", "e.event", "e.at", "kickoff"))


#: Keys that the stream's games are dealt to. A key's games are read, brought up to date and written together, so that calls to the state
#: grow with the keys that a batch touches, not with its games. A stream keeps the number that it was started with.
SHARDS = 4096


class OverdueGames(StatefulProcessor):
    """State of a shard of games: the open ones, the time of each result, the versions that the watermark hasn't passed, and one timer."""

    def __init__(self, days: int, forget_days: int | None):
        self.wait, self.forget = days * DAY_MS, None if forget_days is None else forget_days * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "game_id bigint, seen bigint, kickoff bigint, late boolean")
        self.results = handle.getListState("results", "game_id bigint, seen bigint")
        self.pending = handle.getListState("pending", "game_id bigint, at bigint, done boolean, kickoff bigint")
        self.timer = handle.getValueState("timer", "at bigint")

    @staticmethod
    def _rows(state) -> list[tuple]:
        return [tuple(None if pd.isna(v) else v for v in r) for r in state.get()] if state.exists() else []

    def _put(self, state, rows: list[tuple]) -> None:
        state.put(rows) if rows else state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = pd.concat([f[["game_id", "at", "done", "kickoff"]] for f in rows]).drop_duplicates()
        self.pending.appendList([(int(g), int(at), bool(done), None if pd.isna(kickoff) else int(kickoff)) for g, at, done, kickoff in kept.itertuples(index=False, name=None)])
        first, set_ = int(kept["at"].min()), self.timer.get()[0] if self.timer.exists() else None
        if set_ is None or first < set_:
            if set_ is not None:
                self.handle.deleteTimer(set_)
            self.handle.registerTimer(first)
            self.timer.update((first,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Brings the shard's games up to the watermark, and sets the timer to what comes next."""
        now = timerValues.getCurrentWatermarkInMs()
        left, ready = [], {}
        for v in self._rows(self.pending):
            game, at, done, kickoff = v
            if at > now:
                left.append(v)
            else:
                of = ready.setdefault(game, {})
                of[at] = max(of.get(at, (False, False, 0)), (done, kickoff is not None, kickoff or 0))
        was_open, was_done = self._rows(self.open), self._rows(self.results)
        standing = {g: (seen, kickoff, late) for g, seen, kickoff, late in was_open}
        results = dict(was_done)
        late_now = [g for g, (_, kickoff, late) in standing.items() if g not in ready and not late and kickoff is not None and kickoff + self.wait <= now]
        events: list[tuple] = []
        for game in [*ready, *late_now]:
            seen, kickoff, late = standing.get(game, (results.get(game), None, False))
            seen, kickoff, done, late = self._game(game, (seen, kickoff, game in results, late), ready.get(game, {}), now, events)
            if done:
                results[game] = seen
                standing.pop(game, None)
            else:
                standing[game] = (seen, kickoff, late)
                results.pop(game, None)
        if self.forget is not None:
            results = {g: seen for g, seen in results.items() if seen + self.forget > now}
        if ready:
            self._put(self.pending, left)
        if (now_open := [(g, *v) for g, v in standing.items()]) != was_open:
            self._put(self.open, now_open)
        if (now_done := list(results.items())) != was_done:
            if now_done[: len(was_done)] == was_done:
                self.results.appendList(now_done[len(was_done) :])
            else:
                self._put(self.results, now_done)
        following = [v[1] for v in left] + [kickoff + self.wait for _, kickoff, late in standing.values() if not late and kickoff is not None]
        following += [seen + self.forget for seen in results.values()] if self.forget is not None else []
        if following:
            self.handle.registerTimer(min(following))
            self.timer.update((min(following),))
        else:
            self.timer.clear()
        if events:
            yield pd.DataFrame({"game_id": [e[0] for e in events], "event": [e[1] for e in events], "at": [e[2] for e in events], "kickoff": pd.array([e[3] for e in events], dtype="Int64")})

    def _game(self, game: int, before: tuple, ready: dict[int, tuple], now: int, events: list[tuple]) -> tuple:
        """(seen, kickoff, done, late) of a game after its ``ready`` versions and the time up to ``now``; what happened is added to ``events``."""
        seen, kickoff, done, late = before

        def wait_until(limit: int) -> bool:
            """Whether the game became overdue before ``limit``."""
            if seen is None or done or late or kickoff is None or max(kickoff + self.wait, seen) >= limit:
                return late
            events.append((game, "overdue", max(kickoff + self.wait, seen), kickoff))
            return True

        for at, (has_result, known, moved) in sorted(ready.items()):
            if done and self.forget is not None and seen + self.forget <= at:
                seen, kickoff, done = None, None, False
            late = wait_until(at)
            if done:
                continue
            seen, kickoff = at, moved if known else None
            if has_result:
                if late:
                    events.append((game, "result", at, kickoff))
                done, late = True, False
            elif late and (kickoff is None or kickoff + self.wait > at):
                events.append((game, "rescheduled", at, kickoff))
                late = False
        return seen, kickoff, done, wait_until(now + 1)

    def close(self) -> None:
        pass


def overdue_stream(versions: DataFrame, days: int, delay: str = "0 seconds", forget_days: int | None = None, shards: int = SHARDS) -> DataFrame:
    """Events of a stream of versions, final when they come. The clock is the newest ``captured_at`` less ``delay``; what comes later than
    that is dropped. A game with a result keeps a row of state, or loses it ``forget_days`` after its result: a version after that
    starts the game anew. Needs the RocksDB state store (``with_timers``)."""
    rows = versions.withColumn("captured_at", F.col("captured_at").cast("timestamp")).withWatermark("captured_at", delay)
    rows = rows.select("captured_at", *_version()).where("game_id IS NOT NULL").withColumn("shard", F.pmod(F.xxhash64("game_id"), F.lit(shards)).cast("int"))
    return _as_times(rows.groupBy("shard").transformWithStateInPandas(OverdueGames(days, forget_days), EVENTS, "Append", "EventTime"))


@contextmanager
def with_timers(spark: SparkSession):
    """Queries started within use the RocksDB state store, on disk, whatever the session's default is."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def landed_versions(spark: SparkSession, folder: str) -> DataFrame:
    """Versions of games of schedule files as they land; a file's time counts as that of its capture."""
    raw = spark.readStream.schema("value string").option("wholetext", True).format("text").load(folder)
    records = schedule_records(raw.select(F.col("_metadata.file_modification_time").alias("captured_at"), F.col("value").alias("payload")))
    return records.select(F.col("id").alias("game_id"), "captured_at", "completed", F.try_to_timestamp("startDate").alias("game_date"))


def watch_overdue(versions: DataFrame, root: str, days: int, delay: str = "0 seconds", forget_days: int | None = None) -> None:
    """Process what a stream of versions has, then stop: events are added to ``root/events``, state is kept in ``root/_state``."""
    with with_timers(versions.sparkSession):
        writer = overdue_stream(versions, days, delay, forget_days).writeStream.format("parquet").outputMode("append")
        query = writer.option("checkpointLocation", f"{root}/_state").trigger(availableNow=True).start(f"{root}/events")
    query.awaitTermination()
