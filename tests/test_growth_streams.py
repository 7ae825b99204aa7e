"""Streams: calls to the state and work a second don't grow with seconds that wait or with windows."""

import pandas as pd

from logquill.streaming import alerts, timed


class Map(dict):
    """A map state that counts calls."""

    calls = 0

    def _on(self, value=None):
        self.calls += 1
        return value

    def containsKey(self, k):  # noqa: N802
        return self._on(tuple(k) in self)

    def getValue(self, k):  # noqa: N802
        return self._on(self.get(tuple(k)))

    def updateValue(self, k, v):  # noqa: N802
        self._on(self.__setitem__(tuple(k), v))

    def removeKey(self, k):  # noqa: N802
        self._on(self.pop(tuple(k), None))

    def iterator(self):
        return iter(self._on(list(self.items())))

    def keys(self):
        return list(super().keys())


class Value:
    state = None

    def exists(self):
        return self.state is not None

    def get(self):
        return self.state

    def update(self, state):
        self.state = state

    def clear(self):
        self.state = None


class Handle:
    def __init__(self):
        self.map, self.value, self.timers = Map(), Value(), []

    def getMapState(self, *_):  # noqa: N802
        return self.map

    def getValueState(self, *_):  # noqa: N802
        return self.value

    def registerTimer(self, ms):  # noqa: N802
        self.timers.append(ms // 1000)


class At:
    def __init__(self, second):
        self.second = second

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.second * 1000


def test_state_is_called_by_stretch_and_seconds_come_in_order():
    seen, handle, n = [], Handle(), 3 * timed.STRETCH_S

    def fold(key, state, due, settled):
        seen.extend(due)
        return [(key[0], len(due))], {"n": (state or {"n": 0})["n"] + len(due)}, None

    own = timed.Settled(fold, ("sec",), ("tot", "err"), ("key", "n"))
    own.init(handle)
    rows = pd.DataFrame({"sec": range(n), "tot": 2, "err": 1}).sample(frac=1, random_state=1)
    list(own.handleInputRows(("k",), iter([rows[:5000], rows[5000:], rows[:10]]), None))
    assert handle.timers == [0]
    settled = n - 100
    out = pd.concat(own.handleExpiredTimer(("k",), At(settled), None))
    twice = set(rows["sec"][:10])
    assert seen == [(s, (4, 2) if s in twice else (2, 1)) for s in range(settled + 1)]
    assert out["n"].sum() == settled + 1 and handle.value.state == (f'{{"n": {settled + 1}}}',) and handle.timers[-1] == settled + 1
    list(own.handleExpiredTimer(("k",), At(n + 5), None))
    assert len(seen) == n and not handle.map and handle.map.calls < 60


def test_sums_that_slide_are_those_of_the_last_seconds():
    state, counts = alerts.emptied((3, 7), 2), [(i % 5, i % 3) for i in range(40)]
    for i, now in enumerate(counts):
        sums = alerts.slid(state, (3, 7), now)
        assert [tuple(x) for x in sums] == [tuple(map(sum, zip(*counts[max(0, i + 1 - w) : i + 1], strict=True))) for w in (3, 7)]
    assert len(state["ring"]) == 7
