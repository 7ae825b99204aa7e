"""Folds along each key's seconds, spread over hours.

Chains of a few hours of a key are folded at the same time, each from a guessed state. What comes out of an hour is what should have gone
into the next one. A walk over the hours of a key, of which each is a row by now, follows states from the first hour on: an hour that was
folded from such a state, or from one of which its fold says that it makes no difference, hands its own end on; from any other a new chain is
folded, up to the hour that was folded from the state it has then. Chains of a round don't overlap, and so on until there are none.

States that forget, as averages and counters of runs do, agree after an hour or two whatever was guessed, so two or three rounds are usual. A state
that is kept for long (a baseline frozen by an alert that stays open) moves on by a chain a round, so rounds are never more than hours divided by LONG,
and a few. A task holds the rows of a chain."""

from __future__ import annotations

import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logquill.operators.windows import CHUNK_S
from logquill.sources.tables import written

#: (an hour's rows in order, the state before it) -> (its output, the state after it)
Fold = Callable[[pa.Table, dict], tuple[pa.Table, dict]]
#: (an hour's rows in order, the state before it) -> (the state after it, what `follow` needs besides)
Brief = Callable[[pa.Table, dict], tuple[dict, dict]]
#: (state of which an hour was folded, its Brief, another state) -> the state after the hour for the other one, None if that isn't known
Follow = Callable[[dict, tuple[dict, dict], dict], dict | None]
#: Hours of a chain, in the first round and in later ones.
TOLERANCE, SHORT, LONG = 1e-12, 8, 64
WALKED = "key string, _hour long, state string, chain long, known string"


def same(a: dict, b: dict) -> bool:
    """Whether two states are the same; numbers may differ by TOLERANCE."""
    return all(abs(x - b[c]) <= TOLERANCE if isinstance(x, float) else x == b[c] for c, x in a.items())


Known = dict[int, list[tuple[dict, tuple[dict, dict]]]]


def walked(hours: list[tuple[int, dict]], known: Known, follow: Follow, reach: int) -> list[tuple[int, dict, int | None]]:
    """(hour, state before it, first hour of the chain that it is to be folded in, or None) of each of a key's hours (hour, guess). known
    holds what has been folded, the latest last. The last hour's end isn't needed."""
    out, i, state = [], 0, hours[0][1]
    while i < len(hours) - 1:
        hour = hours[i][0]
        after = next((x for c in reversed(known.get(hour, [])) if (x := follow(*c, state)) is not None), None)
        if after is not None:
            out.append((hour, state, None))
            i, state = i + 1, after
            continue
        stop = min(i + reach, len(hours) - 1)
        out += [(later, state, hour) for later, _ in hours[i:stop]]
        last = hours[stop - 1][0]
        i, state = stop, known[last][-1][1][0] if last in known else hours[stop][1]
    return [*out, (hours[-1][0], state, None)]


def fold_by_hour(
    rows: DataFrame, guess: Callable[[DataFrame], DataFrame], fold: Fold, state: str, schema: str, hour_s: int = CHUNK_S, brief: Brief | None = None, follow: Follow | None = None
) -> DataFrame:
    """The output (schema) of fold over rows (key, sec, ...). guess tells, of rows with their hour (_hour), a state (state, as columns) for each key and _hour, the right
    one for a key's first hour. Without brief and follow only states that are the same (numbers by TOLERANCE) have the same end."""
    names, by = [c.split()[0] for c in state.split(", ")], ["key", "_hour"]
    brief = brief or (lambda own, before: (fold(own, before)[1], {}))
    follow = follow or (lambda before, told, other: told[0] if same(before, other) else None)
    rows = written(rows.withColumn("_hour", F.floor(F.col("sec") / hour_s)), "fold-rows")

    def chain(own: pa.Table) -> pa.Table:
        own, out = own.sort_by("sec"), []
        hours, starts = np.unique(own["_hour"].to_numpy(), return_index=True)
        before = json.loads(own["state"][0].as_py())
        for hour, a, b in zip(hours.tolist(), starts.tolist(), [*starts[1:].tolist(), own.num_rows], strict=True):
            if out and (earlier := own["known"][a].as_py()) and follow(*json.loads(earlier), before) is not None:
                break
            told = brief(own.slice(a, b - a), before)
            out.append((hour, json.dumps(before), json.dumps(told)))
            before = told[0]
        return pa.table({"key": pa.array([own["key"][0].as_py()] * len(out), pa.string()), **{c: [x[i] for x in out] for i, c in enumerate(("_hour", "state", "told"))}})

    def whole(own: pa.Table) -> pa.Table:
        own = own.sort_by("sec")
        return fold(own, json.loads(own["state"][0].as_py()))[0]

    def walk(reach: int) -> Callable[[pa.Table], pa.Table]:
        def one(own: pa.Table) -> pa.Table:
            own = own.sort_by([("_hour", "ascending"), ("round", "ascending")])
            hours, known = {}, {}
            for hour, before, told in zip(own["_hour"].to_pylist(), own["state"].to_pylist(), own["told"].to_pylist(), strict=True):
                if told is None:
                    hours[hour] = json.loads(before)
                else:
                    known.setdefault(hour, []).append((json.loads(before), json.loads(told)))
            found = [(own["key"][0].as_py(), h, json.dumps(s), c, json.dumps(known[h][-1]) if c is not None and h in known else None) for h, s, c in walked(list(hours.items()), known, follow, reach)]
            kinds = zip(("key", "_hour", "state", "chain", "known"), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()), zip(*found, strict=True), strict=True)
            return pa.table({c: pa.array(v, t) for c, t, v in kinds})

        return one

    hours = guess(rows).select(*by, F.to_json(F.struct(*names)).alias("state"), F.lit(None).cast("string").alias("told"), F.lit(0).alias("round"))
    known, n = written(hours, "fold-hours"), 0  # a row for each key and hour, and for each time that it is folded
    while True:
        states = written(known.groupBy("key").applyInArrow(walk(LONG if n else SHORT), WALKED), "fold-hours")
        todo = states.where("chain IS NOT NULL")
        if todo.isEmpty():
            break
        n += 1
        ends = rows.join(todo, by).groupBy("key", "chain").applyInArrow(chain, "key string, _hour long, state string, told string")
        known = known.union(written(ends, "fold-ends").withColumn("round", F.lit(n)))
    return rows.join(states.select(*by, "state"), by).groupBy(*by).applyInArrow(whole, schema)
