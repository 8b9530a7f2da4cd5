"""Sessions as state of a stream: a token lives for a fixed time after its login, or until its logout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: seconds that a session lasts. Nothing prolongs it.
LIFETIME = 86_400
#: Tokens are followed in so many groups, so that a call of Python serves many.
GROUPS = 1 << 12
CHANGES = "token string, username string, is_admin int, created_us long, expires_us long, change string, at_us long"
STATE = "tokens array<string>, usernames array<string>, is_admin array<int>, created_us array<long>, expires_us array<long>"


def session_changes(events: DataFrame, lifetime: int = LIFETIME, delay: str = "0 seconds", groups: int = GROUPS) -> DataFrame:
    """A stream of logins and logouts as changes of sessions: opened, closed (by a logout) and expired, each at its time.

    events: token, username, is_admin, kind (login or logout) and ts; `delay` is how late they may come. The state holds live sessions only: a timer on
    the event time removes a token when its time is over, though nothing more comes for it. A second login with a live token is refused, as its key is
    taken, and prolongs nothing; a logout of a token that is not live changes nothing. Tokens are dealt by hash into `groups`, which a stream's checkpoint is
    bound to; the state of a group is its live sessions, its timer the first end among them.
    """
    import pandas as pd

    names = [c.split(" ")[0] for c in CHANGES.split(", ")]

    def row(token, session, change, us):
        return (token, *session, change, us)

    def follow(key, batches, state):
        out, live = [], {}
        if state.exists:
            tokens, *facts = state.get
            live = dict(zip(tokens, zip(*facts)))
        if not state.hasTimedOut:
            came = [e for batch in batches for e in zip(batch["us"].tolist(), batch["kind"], batch["token"], batch["username"], batch["is_admin"].tolist())]
            for us, kind, token, username, is_admin in sorted(came, key=lambda e: e[:2]):
                session = live.get(token)
                if session and session[3] <= us:
                    out.append(row(token, live.pop(token), "expired", session[3]))
                    session = None
                if kind == "login" and not session:
                    live[token] = session = (username, int(is_admin), us, us + lifetime * 1_000_000)
                    out.append(row(token, session, "opened", us))
                elif kind == "logout" and session:
                    out.append(row(token, live.pop(token), "closed", us))
        now = state.getCurrentWatermarkMs() * 1000
        for token in [t for t, session in live.items() if session[3] <= now]:
            session = live.pop(token)
            out.append(row(token, session, "expired", session[3]))
        if live:
            state.update((list(live), *(list(fact) for fact in zip(*live.values()))))
            state.setTimeoutTimestamp(-(-min(session[3] for session in live.values()) // 1000))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=names)

    ts = F.col("ts").cast("timestamp")
    known = events.where(F.col("token").isNotNull() & ts.isNotNull()).select("token", "username", F.coalesce(F.col("is_admin").cast("int"), F.lit(0)).alias("is_admin"), "kind", ts.alias("ts"), F.unix_micros(ts).alias("us"))
    grouped = known.withWatermark("ts", delay).withColumn("_group", F.pmod(F.xxhash64("token"), F.lit(groups)).cast("int"))
    changes = grouped.groupBy("_group").applyInPandasWithState(follow, CHANGES, STATE, "append", "EventTimeTimeout")
    at = lambda name: F.timestamp_micros(f"{name}_us").alias(name if name == "at" else f"{name}_at")
    return changes.select("token", "username", "is_admin", at("created"), at("expires"), "change", at("at"))


def live_sessions(changes: DataFrame, now) -> DataFrame:
    """Sessions open at `now`, from the changes of a stream: opened, not over, and not closed by then."""
    ended = changes.where((F.col("change") == "closed") & (F.col("at") <= now)).select("token", "created_at")
    opened = changes.where((F.col("change") == "opened") & (F.col("created_at") <= now) & (F.col("expires_at") > now))
    return opened.join(ended, ["token", "created_at"], "left_anti").drop("change", "at")


class ChangeLog:
    """foreachBatch sink that appends every batch to one log, once."""

    def __init__(self, store, name: str):
        self.store, self.name = store, name

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        if self.store.mark(self.name) >= epoch:
            return
        with self.store.begin(self.name, epoch) as tx:
            if self.name in tx.next["tables"]:
                tx.append(self.name, batch)
            else:
                tx.create(self.name, batch)

    def read(self) -> DataFrame:
        return self.store.read(self.name)
