"""The live tracker: failures and commands in, bans and unbans out, with one state per address.

State per address: rings, bans and totals (failures, bans, unbans) by jail, count and last ban, and when the next thing
is due; ``streaming.live`` reads it while the tracker runs. Every access to the store is a message between two
processes, each of a third of a millisecond or more, so a turn reads and writes one value once and has one timer. The
value is JSON: nested rows would be converted value by value on both sides of each message. A turn
is of one address, or of a group of addresses: a tracker that catches up with a log, where most addresses have rows in
every micro-batch, takes few turns with ``groups``; one that follows a log need not read addresses without rows.

Expiries are timers. Rows of a turn are taken address by address in order of (ts, seq), so a trigger's size bounds what
a task holds.

Failures behind the watermark are not lost: the watermark moves by their dates, but the dated column does not reach
the operator, so Spark drops none, and the tracker itself puts them out as actions ``late``, or takes them like others.
"""

from __future__ import annotations

import json
from collections import Counter, deque
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from banstream.functions.bans import LONGEST
from banstream.jails import DEFAULT_DECAY, Jail
from banstream.operators.timeline import ACTIONS, State, action_frame, events, expire, step

#: An address's state as it is stored, in a JSON list of the turn's addresses; ``due`` is the second in which a ban ends or a ring is out of reach.
ADDRESS = (
    "ip string, rings array<struct<jail: string, ts: array<bigint>>>, bans array<struct<jail: string, banned_at: bigint, expires_at: bigint>>, "
    "count int, last_ban bigint, totals array<struct<jail: string, failures: bigint, bans: bigint, unbans: bigint>>, due bigint"
)
_ACTION = Row(*[c.split()[0] for c in ACTIONS.split(", ")])
_COLUMNS = ("ip", "ts", "seq", "kind", "jail", "ban_time")
Totals = dict[str, tuple[int, int, int]]
#: The stored addresses of a turn.
Kept = dict[str | None, dict]


def _of_rows(rows: Iterator[Row]) -> Iterator[tuple]:
    """Rows as tuples of ``_COLUMNS``; a row's own access by name takes longer than all that is done with it."""
    pick = None
    for row in rows:
        pick = pick or itemgetter(*[row.__fields__.index(c) for c in _COLUMNS])
        yield pick(tuple(row))


def _of_frames(frames: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """Rows of frames as tuples of ``_COLUMNS``; numbers come as text, since a frame has whole ones and nulls as floats."""
    number = lambda x: int(x) if isinstance(x, str) else None
    text = lambda x: x if isinstance(x, str) else None
    for frame in frames:
        for ip, ts, seq, kind, jail, ban_time in zip(*[frame[c].tolist() for c in _COLUMNS]):
            yield text(ip), number(ts), number(seq), kind, text(jail), number(ban_time)


def _in_order(rows: Iterator[tuple]) -> list[tuple]:
    """The rows of a turn by address, date and place; nulls come last where there are any."""
    rows = list(rows)
    try:
        return sorted(rows, key=itemgetter(0, 1, 2))
    except TypeError:
        return sorted(rows, key=lambda r: (r[0] is None, r[0] or "", r[1] is None, r[1] or 0, r[2] is None, r[2] or 0))


class BanTracker(StatefulProcessor):
    """``step`` with its state in Spark's store; ``processing`` stamps bans with the wall clock, ``event`` with failures' dates."""

    def __init__(self, jails: dict[str, Jail], decay: int, clock: str, behind: str = "late") -> None:
        self.jails, self.decay, self.clock, self.behind = jails, decay, clock, behind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.address = handle.getValueState("address", "addresses string")

    def _load(self) -> tuple[Kept, int | None]:
        """The turn's addresses as they are stored, and its timer."""
        value = self.address.get()
        kept = {} if value is None else {a["ip"]: a for a in json.loads(value[0])}
        return kept, self._timer(kept)

    def _store(self, kept: Kept, timer: int | None, fired: bool = False) -> None:
        """Write the addresses and set their timer; one that has fired goes by itself."""
        self.address.update((json.dumps(list(kept.values()), separators=(",", ":")),))
        if (wanted := self._timer(kept)) == timer:
            return
        if timer is not None and not fired:
            self.handle.deleteTimer(timer)
        if wanted is not None:
            self.handle.registerTimer(wanted)

    def _timer(self, kept: Kept) -> int | None:
        """When the first of the addresses is due, in milliseconds."""
        due = min((a["due"] for a in kept.values() if a["due"] is not None), default=None)
        return None if due is None else min(1000 * due, LONGEST)

    def _open(self, stored: dict | None) -> tuple[State, Totals]:
        state = State()
        if stored is None:
            return state, {}
        state.count, state.last_ban = stored["count"], stored["last_ban"]
        state.rings = {r["jail"]: deque(r["ts"], maxlen=self.jails[r["jail"]].max_retry) for r in stored["rings"] if r["jail"] in self.jails}
        state.bans = {b["jail"]: (b["banned_at"], b["expires_at"]) for b in stored["bans"]}
        return state, {t["jail"]: (t["failures"], t["bans"], t["unbans"]) for t in stored["totals"]}

    def _shut(self, ip: str | None, state: State, totals: Totals) -> dict:
        return {
            "ip": ip,
            "rings": [{"jail": jail, "ts": list(ring)} for jail, ring in state.rings.items()],
            "bans": [{"jail": jail, "banned_at": at, "expires_at": until} for jail, (at, until) in state.bans.items()],
            "count": state.count,
            "last_ban": state.last_ban,
            "totals": [{"jail": jail, "failures": failures, "bans": bans, "unbans": unbans} for jail, (failures, bans, unbans) in totals.items()],
            "due": self._due(state),
        }

    def _due(self, state: State) -> int | None:
        """When a ban ends, or the newest failure of a ring is out of reach."""
        ends = [until for _, until in state.bans.values() if until is not None]
        return min(ends + [max(ring) + self.jails[jail].find_time + 1 for jail, ring in state.rings.items()], default=None)

    def _count(self, totals: Totals, failed: Counter, actions: list[tuple]) -> None:
        """Add to the totals of the jails that something happened in."""
        acted = Counter((a[1], a[2]) for a in actions)
        for jail in {*failed, *(jail for jail, action in acted if action in ("ban", "unban"))}:
            old = totals.get(jail, (0, 0, 0))
            totals[jail] = (old[0] + failed[jail], old[1] + acted[jail, "ban"], old[2] + acted[jail, "unban"])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        return iter([_ACTION(*a) for a in self._take(_of_rows(rows), timerValues)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter([_ACTION(*a) for a in self._pass(timerValues, expiredTimerInfo)])

    def _take(self, rows: Iterator[tuple], timerValues) -> list[tuple]:
        """The actions of a turn's rows."""
        (kept, timer), done = self._load(), []
        now = timerValues.getCurrentProcessingTimeInMs() // 1000 if self.clock == "processing" else None
        watermark = timerValues.getCurrentWatermarkInMs() if self.clock == "event" and self.behind == "late" else None
        # one turn in one micro-batch, bounded by its trigger
        for ip, own in groupby(_in_order(rows), itemgetter(0)):
            (state, totals), out, failed = self._open(kept.get(ip)), [], Counter()
            for _, ts, seq, kind, jail, ban_time in own:
                if kind == "failure" and watermark is not None and 1000 * ts < watermark:
                    out.append((ip, jail, "late", ts, None, None, "behind_watermark", None, seq))
                    continue
                failed[jail] += kind == "failure"
                out += [(ip, *a, None if a[5] == "expired" else seq) for a in step(state, kind, jail, ts, self.jails, self.decay, ban_time, now)]
            self._count(totals, +failed, out)
            kept[ip] = self._shut(ip, state, totals)
            done += out
        self._store(kept, timer)
        return done

    def _pass(self, timerValues, expiredTimerInfo) -> list[tuple]:
        """The actions of a turn's timer."""
        (kept, timer), done = self._load(), []
        clock = timerValues.getCurrentProcessingTimeInMs() if self.clock == "processing" else timerValues.getCurrentWatermarkInMs()
        # all that is due by now, so that one timer is enough
        for ip in [ip for ip, a in kept.items() if a["due"] is not None and 1000 * a["due"] <= clock]:
            (state, totals), out = self._open(kept[ip]), []
            while (due := self._due(state)) is not None and 1000 * due <= clock:
                out += [(ip, *a, None) for a in expire(state, due, self.decay)]
                for jail in [j for j, ring in state.rings.items() if max(ring) < due - self.jails[j].find_time]:
                    del state.rings[jail]
            self._count(totals, Counter(), out)
            kept[ip] = self._shut(ip, state, totals)
            done += out
        self._store(kept, timer, fired=timer == expiredTimerInfo.getExpiryTimeInMs())
        return done

    def close(self) -> None:
        pass


class GroupTracker(BanTracker):
    """A tracker of groups, which have many rows a turn: these come as pandas frames, at a tenth of the cost of rows."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        return self._framed(self._take(_of_frames(rows), timerValues))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        return self._framed(self._pass(timerValues, expiredTimerInfo))

    def _framed(self, actions: list[tuple]) -> Iterator[pd.DataFrame]:
        return iter([action_frame(actions)] if actions else [])


def track_bans(
    failures: DataFrame,
    jails: Sequence[Jail],
    clock: str = "event",
    decay: int = DEFAULT_DECAY,
    commands: DataFrame | None = None,
    initial: DataFrame | None = None,
    late: str = "0 seconds",
    behind: str = "late",
    groups: int | None = None,
) -> DataFrame:
    """The stream of actions (as ``ban_timeline``) for a stream of failures; it needs the RocksDB state store.

    ``clock="event"`` fires expiries as the watermark passes them, ``"processing"`` by the wall clock. ``late`` is how
    far behind the newest date of earlier micro-batches failures may come. Those further behind, and those dated 0 for
    want of a date once the watermark has moved, come out as actions ``late`` and change no state (see
    ``late_rows``); with ``behind="take"`` they are taken whatever their date. Commands are always taken. ``initial``:
    (ip, jail, banned_at, expires_at) to start with.

    ``groups`` keeps addresses in so many groups by their hash, each read and written as a whole; a run that goes on
    from a checkpoint must have the same number. Without it an address is a group of its own.
    """
    if behind not in ("late", "take"):
        raise ValueError(f"behind must be late or take, not {behind}")
    known = {j.jail: j for j in jails if j.enabled}
    rows = events(failures, commands)
    if clock == "event":
        rows = rows.withColumn("event_ts", F.timestamp_seconds("ts")).withWatermark("event_ts", late).drop("event_ts")
    own = F.col("ip") if groups is None else F.pmod(F.xxhash64("ip"), F.lit(groups))
    start = initial.withColumn("own", own).groupBy("own") if initial is not None else None
    form = {"outputStructType": ACTIONS, "outputMode": "Append", "timeMode": "EventTime" if clock == "event" else "ProcessingTime"}
    if groups is not None and start is None:
        texts = rows.withColumns({c: F.col(c).cast("string") for c in ("ts", "seq", "ban_time")})
        return texts.withColumn("own", own).groupBy("own").transformWithStateInPandas(statefulProcessor=GroupTracker(known, decay, clock, behind), **form)
    tracker = (SeededTracker if start is not None else BanTracker)(known, decay, clock, behind)
    return rows.withColumn("own", own).groupBy("own").transformWithState(statefulProcessor=tracker, initialState=start, **form)


class SeededTracker(BanTracker):
    """A tracker that starts with restored bans."""

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        (kept, timer), ip = self._load(), initialState.ip
        state, totals = self._open(kept.get(ip))
        if initialState.jail in self.jails:
            state.bans[initialState.jail] = (initialState.banned_at, initialState.expires_at)
        kept[ip] = self._shut(ip, state, totals)
        self._store(kept, timer)


def late_rows(actions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two outputs of a tracker: what it did, and the failures (jail, ip, ts, seq) that came behind the watermark."""
    late = actions.where("action = 'late'").select("jail", "ip", F.col("at").alias("ts"), F.col("event_seq").alias("seq"))
    return actions.where("action <> 'late'"), late
