"""The life of incidents, from streams of alerts and acknowledgements.

Alerts of a component and rule join its incident while it is DEDUPE_S young or less; an incident that
nobody acknowledged is resolved when IDLE_S have gone without an alert; an alert in the COOLDOWN_S after that
opens it again; any other opens a new one, and its predecessor ends by itself. An incident is told by the
second in which it first opened."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.operators.incidents import COOLDOWN_S, DEDUPE_S, IDLE_S
from logquill.streaming.timed import settled_fold

LIFE = "key string, rule string, incident long, event string, sec long, n long"
ALERT, ACKNOWLEDGED = "alert", "acknowledged"


def follow(key: tuple, state: dict | None, due: list[tuple[int, tuple]], settled: int) -> tuple[list[tuple], dict | None, int | None]:
    """A fold of settled_fold: due holds (second, (what, number)); the state is the current incident and older ones
    that are still open."""
    out: list[tuple] = []
    now = state["now"] if state else None
    open_still = state["old"] if state else []

    def tell(one: dict, event: str, sec: int) -> None:
        out.append((*key, one["incident"], event, sec, one["n"]))

    def pass_to(sec: int) -> None:
        """What happens by itself up to a second."""
        nonlocal open_still
        for one in [*open_still, *([now] if now else [])]:
            if not one["acknowledged"] and not one["resolved"] and one["last"] + IDLE_S < sec:
                one["resolved"] = True
                tell(one, "resolved", one["last"] + IDLE_S + 1)
        open_still = [x for x in open_still if not x["resolved"]]

    for sec, (what, n) in due:
        pass_to(sec)
        if what == ACKNOWLEDGED:
            if now and not now["resolved"] and not now["acknowledged"]:
                now["acknowledged"] = True
                tell(now, "acknowledged", sec)
            continue
        if now and now["resolved"] and sec - now["last"] <= IDLE_S + COOLDOWN_S:
            now |= {"last": sec, "n": now["n"] + n, "resolved": False, "acknowledged": False}
            tell(now, "reopened", sec)
        elif now and not now["resolved"] and sec - now["last"] <= DEDUPE_S:
            now |= {"last": sec, "n": now["n"] + n}
        else:
            if now and not now["resolved"] and not now["acknowledged"]:
                open_still.append(now)
            now = {"incident": sec, "last": sec, "n": n, "acknowledged": False, "resolved": False}
            tell(now, "opened", sec)
    pass_to(settled + 1)
    if now and now["resolved"] and now["last"] + IDLE_S + COOLDOWN_S < settled:
        now = None
    if not now and not open_still:
        return out, None, None
    waits = [x["last"] + IDLE_S for x in (*open_still, *([now] if now else [])) if not x["resolved"] and not x["acknowledged"]]
    waits += [now["last"] + IDLE_S + COOLDOWN_S + 1] if now and now["resolved"] else []
    return out, {"now": now, "old": open_still}, min(waits) if waits else None


def incident_life(alerts: DataFrame, acknowledgements: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """key, rule, incident, event (opened, acknowledged, resolved, reopened), sec, n (alerts so far): the events in
    the lives of incidents, from streams of alerts (key, rule, sec) and acknowledgements (key, rule, sec). Of one second, alerts come
    after acknowledgements; an acknowledgement without an open incident is nothing."""
    own = lambda rows, what: rows.select("key", "rule", "sec", F.lit(what).alias("what"), F.lit(1).cast("long").alias("n"))
    return settled_fold(own(alerts, ALERT).unionByName(own(acknowledgements, ACKNOWLEDGED)), ("key", "rule"), ("sec", "what"), ("n",), follow, LIFE, delay)
