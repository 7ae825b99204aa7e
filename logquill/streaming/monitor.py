"""What a running stream says of itself, and lines whose time is far from the others'."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

FUTURE_S = 300


class Progress(StreamingQueryListener):
    """Counts of a session's streams by query: batches, rows read, rows dropped as late, state rows, and
    whether it ended. `spark.streams.addListener(Progress())`."""

    def __init__(self) -> None:
        self.queries: dict[str, dict] = {}

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.queries[str(event.id)] = {"batches": 0, "rows": 0, "late": 0, "state_rows": 0, "rows_per_second": 0.0, "ended": False}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        own = self.queries[str(p.id)]
        own["batches"] += 1
        own["rows"] += p.numInputRows
        own["late"] += sum(x.numRowsDroppedByWatermark for x in p.stateOperators)
        own["state_rows"] = sum(x.numRowsTotal for x in p.stateOperators)
        own["rows_per_second"] = p.processedRowsPerSecond

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.queries[str(event.id)]["ended"] = True


def split_future(parsed: DataFrame, now_sec: int, bound_s: int = FUTURE_S) -> tuple[DataFrame, DataFrame]:
    """Lines up to bound_s after now_sec, and those beyond, which would push a watermark ahead of all
    others. Lines without a time stay with the first."""
    ahead = F.coalesce(F.col("sec") > now_sec + bound_s, F.lit(False))
    return parsed.where(~ahead), parsed.where(ahead)
