"""The ban timeline: one address's failures and commands, in order, to bans and unbans.

``step`` is the whole state machine, for streams and for timelines with commands. An address's state is small: a
ring of at most max_retry dates per jail, its bans, and one count of automatic bans over all jails. It can't be
divided further, since bans of one jail lengthen those of another.

Without commands the machine needs few of the failures. A ban falls on a *hit*, a failure that ends max_retry failures
within find_time, and only if the first of these is not before the end of the ban before; so of the hits whose first
failures have the same date the first one stands for all. Hits come from one sort of a jail's and address's failures,
and what is left of them is at most one for each second, however many failures there are. An address's hits are then
folded in the JVM; those of an address with more than ``FOLDED`` stream through the same fold in Python. Addresses
without a hit go no further than the sort.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from banstream.functions.bans import LONGEST, MOST_DOUBLINGS
from banstream.jails import DEFAULT_DECAY, Jail
from banstream.operators.failures import FOREVER

#: Hits of an address that are folded as one array.
FOLDED = 10_000
ACTIONS = "ip string, jail string, action string, at long, expires_at long, ban_time long, reason string, level int, event_seq long"


@dataclass
class State:
    rings: dict[str, deque[int]] = field(default_factory=dict)
    bans: dict[str, tuple[int, int | None]] = field(default_factory=dict)
    count: int = 0
    last_ban: int = 0


def ban_seconds(jail: Jail, count: int) -> int:
    """Python twin of ``functions.bans.calc_ban_time`` for one ban."""
    if not jail.bantime_increment or jail.ban_time < 0:
        return jail.ban_time
    steps = jail.bantime_multipliers
    times = float(steps[min(count, len(steps) - 1)]) if steps else 2.0 ** min(count, MOST_DOUBLINGS)
    raised = jail.ban_time * times * jail.bantime_factor
    whole = max(-LONGEST, min(LONGEST, int(raised)))
    return min(whole, jail.bantime_maxtime) if jail.bantime_maxtime > 0 else whole


def expire(state: State, now: int, decay: int) -> list[tuple]:
    """Unbans that are due at ``now``, in order of expiry; forgets the count after a quiet time."""
    due = sorted((until, jail) for jail, (_, until) in state.bans.items() if until is not None and until <= now)
    for _, jail in due:
        del state.bans[jail]
    if decay > 0 and state.count and state.last_ban < now - decay:
        state.count = 0
    return [(jail, "unban", until, None, None, "expired", None) for until, jail in due]


def _ban(state: State, jail: str, at: int, seconds: int, reason: str, level: int | None) -> tuple:
    until = None if seconds < 0 else min(LONGEST, at + seconds)
    state.bans[jail] = (at, until)
    state.rings.pop(jail, None)
    return (jail, "ban", at, until, seconds, reason, level)


def step(state: State, kind: str, jail: str, ts: int, jails: dict[str, Jail], decay: int = DEFAULT_DECAY, ban_time: int | None = None, now: int | None = None) -> list[tuple]:
    """Take one event (``failure``, ``ban``, ``unban`` or ``apply_failed``) and return its actions:
    (jail, action, at, expires_at, ban_time, reason, level). ``now`` is the clock, the event's date if not given."""
    now = ts if now is None else now
    out = expire(state, now, decay)
    own = jails.get(jail)
    if kind == "apply_failed":
        if state.bans.pop(jail, None) is not None:
            out.append((jail, "rollback", now, None, None, "firewall_ban_failed", None))
    elif own is None:
        if kind != "failure":
            out.append((jail, "error", now, None, None, "unknown_jail", None))
    elif kind == "unban":
        done = state.bans.pop(jail, None) is not None
        out.append((jail, "unban", now, None, None, "manual", None) if done else (jail, "error", now, None, None, "not_banned", None))
    elif kind == "ban":
        if jail in state.bans:
            out.append((jail, "error", now, None, None, "already_banned", None))
        else:
            out.append(_ban(state, jail, now, own.ban_time if ban_time is None else ban_time, "manual", None))
    elif jail not in state.bans:
        ring = state.rings.setdefault(jail, deque(maxlen=own.max_retry))
        ring.append(ts)
        if len(ring) == own.max_retry and ring[-1] - ring[0] <= own.find_time:
            seconds = ban_seconds(own, state.count)
            out.append(_ban(state, jail, now, seconds, "threshold", state.count))
            state.count, state.last_ban = state.count + 1, now
    return out


def events(failures: DataFrame, commands: DataFrame | None = None) -> DataFrame:
    """Failures and commands (kind, ip, jail, ban_time, ts, seq) as one table."""
    own = failures.select(F.lit("failure").alias("kind"), "ip", "jail", F.lit(None).cast("long").alias("ban_time"), F.col("ts").cast("long").alias("ts"), F.col("seq").cast("long").alias("seq"))
    return own if commands is None else own.unionByName(commands.select("kind", "ip", "jail", "ban_time", "ts", "seq"))


def ban_timeline(failures: DataFrame, jails: Sequence[Jail], decay: int = DEFAULT_DECAY, commands: DataFrame | None = None, until: int | None = None, folded: int = FOLDED) -> DataFrame:
    """All actions, from all events in order of (ts, seq); expiries up to ``until`` where it is given, and else up to
    the last event of their address. Rows without address, date or place are left out."""
    known = {j.jail: j for j in jails if j.enabled}
    rows = events(failures, commands).where("ip is not null and ts is not null and seq is not null")
    # a ban of no length ends among failures of its own date, which hits by date can't tell apart
    stepwise = commands is not None or any(0 in _lengths(j) for j in known.values())
    return _stepped(rows, known, decay, until) if stepwise else _from_hits(rows, list(known.values()), decay, until, folded)


def _stepped(rows: DataFrame, known: dict[str, Jail], decay: int, until: int | None) -> DataFrame:
    """Rows of an address are shuffled together and sorted, and stream through ``step`` in Arrow batches: a task holds
    one address's state and one batch, however many failures an address has."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, state = None, State()

        def close() -> list[tuple]:
            return [] if ip is None or until is None else [(ip, *a, None) for a in expire(state, until, decay)]

        for frame in frames:
            out: list[tuple] = []
            for row in frame.itertuples(index=False):
                if row.ip != ip:
                    out += close()
                    ip, state = row.ip, State()
                wanted = None if pd.isna(row.ban_time) else int(row.ban_time)
                out += [(ip, *a, None if a[5] == "expired" else int(row.seq)) for a in step(state, row.kind, row.jail, int(row.ts), known, decay, wanted)]
            if out:
                yield action_frame(out)
        if out := close():
            yield action_frame(out)

    return rows.repartition("ip").sortWithinPartitions("ip", "ts", "seq").mapInPandas(run, ACTIONS)


#: No ban has ended yet.
NEVER = -(1 << 62)


def hits(failures: DataFrame, jails: Sequence[Jail]) -> DataFrame:
    """(ip, jail, first, ts, seq): of the failures that reach the threshold with the same ``first`` date of those that count, the earliest."""
    retry, find = (F.element_at(F.create_map(*[F.lit(x) for j in jails for x in (j.jail, getattr(j, n))]), F.col("jail")) for n in ("max_retry", "find_time"))
    over = Window.partitionBy("ip", "jail").orderBy("ts", "seq")
    first = F.coalesce(*[F.when(retry == n, F.lag("ts", n - 1).over(over) if n > 1 else F.col("ts")) for n in sorted({j.max_retry for j in jails})])
    found = failures.where(F.col("jail").isin([j.jail for j in jails])).withColumn("first", first).where(F.col("ts") - F.col("first") <= find)
    return found.groupBy("ip", "jail", "first").agg(F.min(F.struct("ts", "seq")).alias("h")).select("ip", "jail", "first", "h.ts", "h.seq")


def _lengths(jail: Jail) -> list[int]:
    """Ban times by count; the last one holds for all counts beyond."""
    most = len(jail.bantime_multipliers) - 1 if jail.bantime_multipliers else MOST_DOUBLINGS
    return [ban_seconds(jail, n) for n in range(most + 1 if jail.bantime_increment else 1)]


def _from_hits(rows: DataFrame, jails: Sequence[Jail], decay: int, until: int | None, folded: int) -> DataFrame:
    if not jails:
        return rows.sparkSession.createDataFrame([], ACTIONS)
    number = F.element_at(F.create_map(*[F.lit(x) for i, j in enumerate(jails) for x in (j.jail, i)]), F.col("jail"))
    found = hits(rows, jails).withColumns({"n": number, "_of": F.count(F.lit(1)).over(Window.partitionBy("ip"))})
    few = found.where(F.col("_of") <= folded).groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("ts", "seq", "n", "first"))).alias("hits"))
    bans = few.select("ip", F.inline(_fold(F.col("hits"), jails, decay)))
    many = found.where(F.col("_of") > folded).repartition("ip").sortWithinPartitions("ip", "ts", "seq").select("ip", "ts", "seq", "n", "first")
    bans = bans.unionByName(many.mapInPandas(_walk(jails, decay), "ip string, n int, at long, expires_at long, ban_time long, level int, event_seq long"))
    names = F.array(*[F.lit(j.jail) for j in jails])
    said = bans.select("ip", F.get(names, F.col("n")).alias("jail"), "at", "expires_at", "ban_time", "level", "event_seq")
    newest = F.max("ts") if until is None else F.greatest(F.max("ts"), F.lit(until).cast("long"))
    ends = said.join(rows.groupBy("ip").agg(newest.alias("_last")), "ip").withColumn("_ends", F.col("expires_at") <= F.col("_last"))
    none = lambda kind: F.lit(None).cast(kind)
    ban = F.struct(F.lit("ban").alias("action"), "at", "expires_at", "ban_time", F.lit("threshold").alias("reason"), "level", "event_seq")
    unban = F.struct(F.lit("unban").alias("action"), F.col("expires_at").alias("at"), none("long").alias("expires_at"), none("long").alias("ban_time"), F.lit("expired").alias("reason"), none("int").alias("level"), none("long").alias("event_seq"))
    return ends.select("ip", "jail", F.inline(F.array_compact(F.array(ban, F.when(F.col("_ends"), unban)))))


def _fold(found: Column, jails: Sequence[Jail], decay: int) -> Column:
    """The bans (n, at, expires_at, ban_time, level, event_seq) of an address's hits (ts, seq, n, first) in order."""
    lengths = F.array(*[F.array(*[F.lit(x).cast("long") for x in _lengths(j)]) for j in jails])
    ban = "struct<n: int, at: bigint, expires_at: bigint, ban_time: bigint, level: int, event_seq: bigint>"
    start = F.struct(
        F.array_repeat(F.lit(NEVER).cast("long"), len(jails)).alias("ends"), F.lit(0).alias("count"), F.lit(0).cast("long").alias("last"), F.array().cast(f"array<{ban}>").alias("bans")
    )

    def merge(state: Column, hit: Column) -> Column:
        quiet = (F.lit(decay > 0)) & (state["last"] < hit["ts"] - decay)
        level = F.when(quiet, 0).otherwise(state["count"])
        own = F.get(lengths, hit["n"])
        seconds = F.get(own, F.least(level, F.size(own) - 1))
        ends = F.when(seconds >= 0, F.least(F.lit(LONGEST), hit["ts"] + seconds))
        made = F.struct(hit["n"].alias("n"), hit["ts"].alias("at"), ends.alias("expires_at"), seconds.alias("ban_time"), level.alias("level"), hit["seq"].alias("event_seq"))
        after = F.struct(
            F.transform(state["ends"], lambda e, i: F.when(i == hit["n"], F.coalesce(ends, F.lit(FOREVER))).otherwise(e)).alias("ends"),
            (level + 1).alias("count"),
            hit["ts"].alias("last"),
            F.concat(state["bans"], F.array(made.cast(ban))).alias("bans"),
        )
        return F.when(hit["first"] >= F.get(state["ends"], hit["n"]), after).otherwise(state)

    return F.aggregate(found, start, merge)["bans"]


def _walk(jails: Sequence[Jail], decay: int):
    """The same fold over hits that stream in by address and in order; one address's state is all it holds."""
    lengths = [_lengths(j) for j in jails]
    names = ["ip", "n", "at", "expires_at", "ban_time", "level", "event_seq"]

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ip, ends, count, last = None, [], 0, 0
        for frame in frames:
            out = []
            for own, ts, seq, n, first in frame.itertuples(index=False, name=None):
                if own != ip:
                    ip, ends, count, last = own, [NEVER] * len(jails), 0, 0
                if first < ends[n]:
                    continue
                level = 0 if decay > 0 and last < ts - decay else count
                seconds = lengths[n][min(level, len(lengths[n]) - 1)]
                until = min(LONGEST, ts + seconds) if seconds >= 0 else None
                out.append((ip, n, ts, until, seconds, level, seq))
                ends[n], count, last = FOREVER if until is None else until, level + 1, ts
            if out:
                yield pd.DataFrame(out, columns=names).astype({"expires_at": "Int64"})

    return walk


def action_frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=[c.split()[0] for c in ACTIONS.split(", ")])
    return frame.astype({c: "Int64" for c in ("at", "expires_at", "ban_time", "event_seq")} | {"level": "Int32"})


def ban_rows(actions: DataFrame) -> DataFrame:
    """The bans of a timeline: ip, jail, banned_at, expires_at, level."""
    return actions.where("action = 'ban'").select("ip", "jail", F.col("at").alias("banned_at"), "expires_at", "level")
