"""incident_deploy parses only lines that may be deploys."""

from logquill.operators import merged
from logquill.operators.parse import parse
from logquill.sources import loglines


def test_deploys_are_those_of_all_lines(spark):
    lines = loglines.lines_from_events(spark.read.parquet("/root/testdata/sf0.01/events.parquet"))
    few = merged.maybe_deploys(lines)
    told = lambda rows: {tuple(x) for x in merged.deploy_lines(parse(rows)).collect()}
    assert told(few) == told(lines) and told(few)
    assert few.count() * 100 < lines.count()
