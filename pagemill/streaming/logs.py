"""Streams of requests and logs: rolling admission, health of models, log lines of overlapping snapshots, failures by window.

State machines that depend on what came before run per key: on a table in one sorted pass of each key, on a stream with
``transformWithStateInPandas``, whose state store keeps one window or one second of log, whatever the history.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class Window:
    """The requests of an account that count: (time, tokens) in micros, for ``seconds`` from each.

    ``rpm`` and ``tpm`` of 0 are no limit; of ``tpm`` the share ``utilisation`` is used.
    """

    def __init__(self, rpm: int, tpm: int, utilisation: float = 0.8, seconds: int = 60, entries: list[tuple[int, int]] | None = None, now: int = 0, cool: int = 0):
        self.rpm, self.tpm, self.span = rpm, int(tpm * utilisation), seconds * 1_000_000
        self.entries, self.now, self.cool = deque(entries or []), now, cool
        self.used = sum(c for _, c in self.entries)

    def _to(self, t: int) -> None:
        self.now = max(self.now, t)
        while self.entries and self.entries[0][0] + self.span <= self.now:
            self.used -= self.entries.popleft()[1]

    def admit(self, at: int, tokens: int) -> int | None:
        """When a request of ``tokens`` that comes at ``at`` goes out; null if it alone is too large."""
        if self.tpm and tokens > self.tpm:
            return None
        self._to(max(at, self.cool))
        while (self.rpm and len(self.entries) >= self.rpm) or (self.tpm and self.used + tokens > self.tpm):
            self._to(self.entries[0][0] + self.span)
        self.entries.append((self.now, tokens))
        self.used += tokens
        return self.now

    def settle(self, sent: int, reserved: int, actual: int | None) -> None:
        """Put what a request really used in place of what it had reserved; its time stays."""
        if actual is not None:
            for k, entry in enumerate(self.entries):
                if entry == (sent, reserved):
                    self.entries[k] = (sent, max(0, actual))
                    self.used += max(0, actual) - reserved
                    return

    def cooldown(self, at: int, seconds: float) -> None:
        """Nothing goes out before; a deadline never comes nearer."""
        self.cool = max(self.cool, at + int(seconds * 1_000_000))


def admit(df: DataFrame, key: str, ts: str, tokens: str, rpm: int, tpm: int, utilisation: float = 1.0, seconds: int = 60) -> DataFrame:
    """Simulated admission of requests in order of time: ``admitted_at`` (micros), null where one alone exceeds the limit.

    A request waits until fewer than ``rpm`` requests and, with its own, at most the usable ``tpm`` tokens lie in the window; an entry
    leaves it when it is exactly ``seconds`` old. Limits of 0 are none; null tokens count as 0. State is one window per account.
    """
    names = df.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        account, window = object(), None
        for frame in frames:
            out = []
            for k, t, c in zip(frame[key], frame["__at"], frame["__tokens"], strict=True):
                if k != account:
                    account, window = k, Window(rpm, tpm, utilisation, seconds)
                out.append(window.admit(int(t), int(c)))
            yield frame.assign(admitted_at=pd.array(out, "Int64"))[[*names, "admitted_at"]]

    timed = df.withColumn("__at", F.unix_micros(F.col(ts).cast("timestamp"))).withColumn("__tokens", F.coalesce(F.col(tokens).cast("long"), F.lit(0)))
    dealt = timed.repartition(key).sortWithinPartitions(key, "__at", "__tokens")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return dealt.mapInPandas(run, f"{fields}, admitted_at long")


class Admission(StatefulProcessor):
    """Accounts' windows on a stream of (account, kind, ticket, at, tokens): request, settle (real tokens of a ticket) or cooldown (seconds)."""

    def __init__(self, rpm: int, tpm: int, utilisation: float, seconds: int):
        self.limits = (rpm, tpm, utilisation, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getListState("entries", "ticket string, at long, tokens long")
        self.clock = handle.getValueState("clock", "now long, cool long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now, cool = self.clock.get() if self.clock.exists() else (0, 0)
        held = [tuple(e) for e in self.entries.get()]
        window = Window(*self.limits, [(a, c) for _, a, c in held], now, cool)
        tickets = {(t, a, c) for t, a, c in held}
        out = []
        for r in pd.concat(list(rows)).fillna({"tokens": 0}).sort_values(["at", "ticket"], kind="stable").itertuples():
            if r.kind == "cooldown":
                window.cooldown(int(r.at), float(r.tokens))
            elif r.kind == "settle":
                for t, a, c in [x for x in tickets if x[0] == r.ticket]:
                    window.settle(a, c, int(r.tokens))
                    tickets = tickets - {(t, a, c)} | {(t, a, max(0, int(r.tokens)))}
            else:
                sent = window.admit(int(r.at), int(r.tokens))
                if sent is not None:
                    tickets.add((r.ticket, sent, int(r.tokens)))
                out.append((key[0], r.ticket, sent))
        alive = [(t, a, c) for t, a, c in sorted(tickets, key=lambda x: (x[1], x[0])) if a + window.span > window.now]
        self.clock.update((window.now, window.cool))
        self.entries.put(alive) if alive else self.entries.clear()
        yield pd.DataFrame({"account": [x[0] for x in out], "ticket": [x[1] for x in out], "admitted_at": pd.array([x[2] for x in out], "Int64")})

    def close(self) -> None:
        pass


def admit_stream(stream: DataFrame, rpm: int, tpm: int, utilisation: float = 0.8, seconds: int = 60) -> DataFrame:
    """(account, ticket, admitted_at) of a stream of (account, kind, ticket, at, tokens); needs the RocksDB state store."""
    kind = stream.schema["account"].dataType.simpleString()
    return stream.groupBy("account").transformWithStateInPandas(Admission(rpm, tpm, utilisation, seconds), f"account {kind}, ticket string, admitted_at long", "append", "none")


class Follow(StatefulProcessor):
    """Counts of a log's lines in its last second, by line; a snapshot's lines beyond them are new."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "digest string", "base string, nanos string, count long")
        self.last = handle.getValueState("last", "base string, nanos string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows)).sort_values(["snapshot", "seq"], kind="stable")
        have = {k[0]: list(v) for k, v in self.seen.iterator()}
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for _, own in frame.groupby("snapshot", sort=True):
            left = {k: v[2] for k, v in have.items()}
            for r in own.itertuples():
                if left.get(r.digest, 0) > 0:
                    left[r.digest] -= 1
                else:
                    out.append((key[0], r.snapshot, r.seq, r.line))
                    have.setdefault(r.digest, [r.base, r.nanos, 0])[2] += 1
                last = max(last, (r.base, r.nanos)) if last else (r.base, r.nanos)
            edge = (pd.Timestamp(f"{last[0]}.{last[1]}") - pd.Timedelta(seconds=1)) if last else None
            have = {k: v for k, v in have.items() if pd.Timestamp(f"{v[0]}.{v[1]}") >= edge}
        self.seen.clear()
        for k, v in have.items():
            self.seen.updateValue((k,), tuple(v))
        if last:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["log", "snapshot", "seq", "line"])

    def close(self) -> None:
        pass


def follow_stream(stream: DataFrame) -> DataFrame:
    """New lines of a stream of (log, snapshot, seq, line), whose snapshots overlap by a second; a line's time is its first word.

    Equal lines of a snapshot stay; what an earlier snapshot had within the last second counts once for each time it stood there. Lines
    without a time are left out. Needs the RocksDB state store.
    """
    from pagemill.operators.jobs import log_order

    own = stream.withColumn("o", log_order(F.split("line", " ")[0])).filter("o is not null")
    own = own.select("log", "snapshot", "seq", "line", F.sha2("line", 256).alias("digest"), "o.base", "o.nanos")
    kinds = {c: stream.schema[c].dataType.simpleString() for c in ("log", "snapshot", "seq")}
    return own.groupBy("log").transformWithStateInPandas(Follow(), f"log {kinds['log']}, snapshot {kinds['snapshot']}, seq {kinds['seq']}, line string", "append", "none")


def failure_counts(stream: DataFrame, ts: str, key: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """Failures of a key in tumbling windows of event time; works on a stream and on a table."""
    timed = stream.withColumn("at", F.col(ts).cast("timestamp"))
    if stream.isStreaming:
        timed = timed.withWatermark("at", late)
    return timed.groupBy(F.window("at", f"{minutes} minutes"), key).agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count("*").alias("n"))
