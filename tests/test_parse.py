"""Line classes and fields against a plain per-line reading."""

import random

import pytest
from pyspark.sql import functions as F

from logquill.functions import parse as p
from logquill.operators import counting, drift
from logquill.operators.parse import counted, parse, rejected
from logquill.sources import loglines
from logquill.sources import vocabulary as voc

GOOD = b"1790603412345|I|CLM|STR|00000|000041|a91f03c2|claim persisted claim=CLM-88213"
KEYS = {r[1] for r in voc.DEFAULT.component_rows()}
CODES = {c[0] for c in voc.CODES} | {voc.SUCCESS}
SEPARATORS = (13, 15, 19, 23, 29, 36, 45)


def read(line: bytes) -> tuple:
    """class, key, ts_ms, latency of a line."""
    if line.endswith(b"\r"):
        line = line[:-1]
    if len(line) > 8192:
        return ("oversized_line",)
    if len(line) < 46 or any(line[i : i + 1] != b"|" for i in SEPARATORS):
        return ("malformed_header",)
    digits = lambda b: all(48 <= x <= 57 for x in b)
    if not digits(line[:13]):
        return ("bad_timestamp",)
    if line[14:15] not in (b"I", b"W", b"E", b"F"):
        return ("bad_level",)
    key = line[16:19].decode("latin1") + "." + line[20:23].decode("latin1")
    if key not in KEYS:
        return ("unknown_component",)
    latency = int(line[30:36]) if digits(line[30:36]) else -1
    kind = "valid"
    if line[24:29].decode("latin1") not in CODES:
        kind = "unknown_code"
    try:
        line[46:].decode()
    except UnicodeDecodeError:
        kind = "non_utf8_message"
    return (kind, key, int(line[:13]), latency)


def put(line: bytes, at: int, new: bytes) -> bytes:
    return line[:at] + new + line[at + len(new) :]


CASES = {
    "good": (GOOD, "valid"), "garbage": (b"garbage", "malformed_header"), "empty": (b"", "malformed_header"), "short": (GOOD[:45], "malformed_header"),
    "header_only": (GOOD[:46], "valid"), "sep_13": (put(GOOD, 13, b" "), "malformed_header"), "sep_45": (put(GOOD, 45, b"x"), "malformed_header"),
    "pipes": (b"|" * 60, "bad_timestamp"), "nuls": (b"\0" * 100, "malformed_header"), "bad_ts": (put(GOOD, 12, b"a"), "bad_timestamp"), "bad_level": (put(GOOD, 14, b"X"), "bad_level"),
    "unknown": (put(GOOD, 16, b"ZZZ|QQQ"), "unknown_component"), "code": (put(put(GOOD, 14, b"E"), 24, b"E9999"), "unknown_code"),
    "non_utf8": (GOOD + b"\xff\xfe", "non_utf8_message"), "oversized": (GOOD + b"x" * 9000, "oversized_line"), "longest": (GOOD + b"x" * (8192 - len(GOOD)), "valid"),
    "crlf": (GOOD + b"\r", "valid"), "bad_latency": (put(GOOD, 30, b"+00041"), "valid"), "multibyte": (GOOD + "é".encode(), "valid"), "fatal": (put(GOOD, 14, b"F"), "valid"),
    "high_byte_header": (put(GOOD, 37, b"\xc3\xa9"), "valid"),
}


@pytest.fixture(scope="module")
def by_name(spark):
    rows = [(n, bytearray(line)) for n, (line, _) in CASES.items()]
    df = spark.createDataFrame(rows, "name string, data binary").select("name", F.col("data").cast("string").alias("value"))
    return {r["name"]: r for r in parse(df).collect()}


@pytest.mark.parametrize("name", CASES)
def test_class(by_name, name):
    line, kind = CASES[name]
    row = by_name[name]
    assert row["class"] == kind == read(line)[0]
    if len(read(line)) > 1:
        assert (row["key"], row["ts_ms"], row["latency_ms"]) == read(line)[1:]


def test_fields(by_name):
    row = by_name["good"]
    assert (row["level"], row["level_class"], row["code"], row["trace"], row["message"], row["raw_len"]) == ("I", 0, "00000", "a91f03c2", "claim persisted claim=CLM-88213", len(GOOD))
    assert by_name["crlf"]["message"] == row["message"]
    assert by_name["code"]["flags"] == ["unknown_code"]
    assert by_name["pipes"]["flags"][0] == "bad_timestamp" and "bad_level" in by_name["pipes"]["flags"]


def test_corrupted_lines_read_as_one_by_one(spark):
    rng = random.Random(7)
    lines = []
    for _ in range(1500):
        line = bytearray(GOOD)
        for _ in range(rng.randint(0, 3)):
            line[rng.randrange(len(line))] = rng.choice(b"|0a9XEW\xff ~")
        lines.append(bytes(line[: rng.choice([len(line), len(line), 46, 40])]))
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(lines)], "i long, data binary").select("i", F.col("data").cast("string").alias("value"))
    for r in parse(df).collect():
        want = read(lines[r["i"]])
        assert (r["class"], r["key"], r["ts_ms"], r["latency_ms"])[: len(want)] == want, lines[r["i"]]


def test_nothing_is_lost(spark):
    events = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    lines = loglines.lines_from_events(events)
    index, first, last = loglines.SILENT
    silent = events.where((F.pmod("user_id", F.lit(20)) == index) & F.floor(F.col("event_id") * 20 / 1000).between(first, last)).count()
    parsed = parse(lines).cache()
    assert counted(parsed).count() + rejected(parsed).count() == events.count() - silent and silent
    assert counting.per_second(parsed).agg(F.sum("tot")).first()[0] == counted(parsed).count()
    parsed.unpersist()


def test_text_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(GOOD + b"\n" + GOOD + b"\r\n" + GOOD + b"\xff\nunfinished")
    kinds = [r["class"] for r in parse(loglines.read_log(spark, str(tmp_path))).collect()]
    assert sorted(kinds) == ["malformed_header", "non_utf8_message", "valid", "valid"]
    assert loglines.read_log(spark, str(tmp_path), max_lines=2).count() == 2


def test_format_round_trip_and_widths(spark):
    fields = [F.lit(v) for v in (1790603412345, "E", "CLM", "STR", "E4410", 41, "a91f03c2", "m")]
    line = spark.range(1).select(loglines.format_line(*fields).alias("value"))
    assert parse(line).first()["class"] == "valid"
    for at, bad in ((1, "Q"), (2, "CL"), (4, "E44"), (5, 1_000_000), (6, "xyz"), (7, "a\nb")):
        broken = [*fields]
        broken[at] = F.lit(bad)
        with pytest.raises(Exception, match="doesn't fit"):
            spark.range(1).select(loglines.format_line(*broken)).collect()


@pytest.mark.parametrize(("latency", "want"), [(0, 0), (1, 1), (2, 2), (3, 2), (4, 3), (5, 3), (511, 9), (512, 10), (1023, 10), (1024, 11), (999999, 18), (-1, 19)])
def test_latency_bin(spark, latency, want):
    assert spark.range(1).select(p.latency_bin(F.lit(latency))).first()[0] == want


def test_percentiles(spark):
    rows = [("a", 4, 90), ("a", 10, 10), ("b", 5, 95), ("b", 10, 5), ("c", 0, 5), ("d", 19, 100), ("d", 3, 1)]
    got = {r["key"]: (r["upper_ms"], r["lower_ms"]) for r in drift.percentiles(spark.createDataFrame(rows, "key string, bin int, n long")).collect()}
    assert got == {"a": (1024, 512), "b": (32, 16), "c": (1, 0), "d": (8, 1 << 18)}


def test_vocabulary_is_validated():
    assert len(voc.COMPONENTS) == 20 and len(voc.CODES) == 46 and sum(c[3] for c in voc.COMPONENTS) == 2812
    with pytest.raises(voc.ConfigError):
        voc.Vocabulary(codes=(*voc.CODES, ("E1", "STR", 1.0, 1, 1, "x")))
    with pytest.raises(voc.ConfigError):
        voc.Vocabulary(edges=(("CLM.STR", "CLM.NOP", 0.5, 1),))
    with pytest.raises(voc.ConfigError):
        voc.Vocabulary(components=(*voc.COMPONENTS, voc.COMPONENTS[0]))
