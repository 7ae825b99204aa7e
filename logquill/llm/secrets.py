"""Secret scans, in DataFrame functions only.

Patterns give the base spans. Beside them, two character Markov models, one of random strings and
one of ordinary identifiers, are compared on every long run of identifier characters: a run whose
mean log-likelihood ratio a character passes a threshold, which is stricter for runs without a
digit, is a span of kind "markov"; shorter runs aren't compared. The models
are trained from labelled samples: random strings are the values that the base patterns found in a
bounded sample of documents, and digests written in hexadecimal, base64 and capitals; ordinary ones are the
identifiers of that sample outside base matches. What the driver sees of them is one count per
model and pair of characters, a bounded table.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logquill.llm.common import free_name

_ASSIGN = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Patterns of the base, in their order of kind: (kind, pattern, group of the value, its least length, hint). A run
#: of hex digits or of an access key's characters is taken whole, so its least length is in the pattern; a text
#: with an assign span that is kept has the hint.
KINDS = (
    ("assign", _ASSIGN, 2, 8, _ASSIGN.removesuffix("+)") + "{8,})"),
    ("access", "AKIA[A-Z0-9]{12,}", 0, 16, "AKIA[A-Z0-9]{12,}"),
    ("hex", "[0-9a-f]{32,}", 0, 32, "[0-9a-f]{32,}"),
)
RUN = "[A-Za-z0-9+/_=-]{20,}"
MARKOV = "markov"
#: Characters a run may hold are counted by code, from 32 on, in a square table.
CODES = 96
#: Documents and strings of each label that the models are trained from, at most.
SAMPLE_DOCS, SAMPLE_STRINGS = 2000, 20000
#: Mean log-likelihood ratio a character from which on a run with a digit counts as random, and one without.
THRESHOLD, THRESHOLD_LETTERS = 0.35, 0.7
#: Elements that a running value is folded over at a time, and code points of a block of text.
FOLD, BLOCK = 64, 256
SPANS = "array<struct<start:int,order:int,end:int,kind:string,value:string>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """What op makes, from 0 on, of the numbers before each place. Arrays are folded in blocks, blocks
    of blocks and what is left, so that no long array is copied for each of its elements."""

    def fold(xs: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(xs, start, lambda s, x: F.struct(op(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    def level(xs: Column, upper: Callable[[Column], Column]) -> Column:
        cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / FOLD).cast("int")), lambda i: F.slice(v, i * FOLD + 1, FOLD))
        whole = lambda block: F.aggregate(block, F.lit(0), op)
        add = lambda block, base: F.transform(fold(block), lambda x: op(base, x))
        joined = lambda v: let(cut(v), lambda blocks: F.flatten(F.zip_with(blocks, upper(F.transform(blocks, whole)), add)))
        return let(xs, lambda v: F.when(F.size(v) > FOLD, joined(v)).otherwise(fold(v)))

    return level(values, lambda sums: level(sums, fold))


def match_spans(text: Column, pattern: str, kind: str, order: int, group: int = 0, least: int = 0) -> Column:
    """Leftmost, non-overlapping matches as SPANS, in code points, those whose group is shorter than
    `least` left out.

    Each match is taken with the gap before it (anchored where the last one ended), so the running
    sums of lengths are the places."""
    anchored = F.lit(rf"(?s)\G(.*?)({pattern})")
    every = lambda k: F.regexp_extract_all(text, anchored, F.lit(k))
    steps = F.arrays_zip(every(1).alias("gap"), every(2).alias("found"), (every(2 + group) if group else every(2)).alias("value"))
    sized = F.transform(steps, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["found"]).alias("found"), x["value"].alias("value")))

    def span(x: Column, before: Column) -> Column:
        start = before + x["gap"]
        return F.struct(start.alias("start"), F.lit(order).alias("order"), (start + x["found"]).alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    spans = let(sized, lambda v: F.zip_with(v, running(F.transform(v, lambda x: x["gap"] + x["found"]), lambda a, b: a + b), span))
    return F.filter(spans, lambda x: F.length(x["value"]) >= least)


def none_or(hint: str, text: Column, spans: Column) -> Column:
    """spans where the text holds the hint, else an empty array: most texts are read once."""
    return F.when(text.rlike(hint), spans).otherwise(F.array().cast(SPANS))


def blocks(text: Column, size: int = BLOCK) -> Column:
    """Stretches of text of `size` code points, in order."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{size}}}"), F.lit(0))


def pair_blocks(s: Column) -> Column:
    """Blocks of s, each with the character after it: their pairs of characters are those of s."""
    pattern = F.lit(rf"(?s)(.{{1,{BLOCK}}})(?=(.?))")
    return F.zip_with(F.regexp_extract_all(s, pattern, F.lit(1)), F.regexp_extract_all(s, pattern, F.lit(2)), lambda block, then: F.concat(block, then))


def pair_codes(block: Column) -> Column:
    """Codes of the pairs of characters of a block of two or more."""
    code = lambda i: F.ascii(F.substring(block, i, F.lit(1))) - 32
    return F.transform(F.sequence(F.lit(1), F.length(block) - 1), lambda i: code(i) * CODES + code(i + 1))


def base_spans(text: Column) -> list[Column]:
    """The base spans of each kind."""
    return [none_or(hint, text, match_spans(text, p, kind, i, group, least)) for i, (kind, p, group, least, hint) in enumerate(KINDS)]


def _pairs(strings: DataFrame) -> DataFrame:
    """label, code of the pair of characters, count."""
    parts = strings.select("label", F.explode(pair_blocks(F.col("s"))).alias("s")).where(F.length("s") >= 2)
    return parts.select("label", F.explode(pair_codes(F.col("s"))).alias("pair")).groupBy("label", "pair").agg(F.count("*").alias("n"))


def training_strings(docs: DataFrame) -> DataFrame:
    """(label, s): random (1) and ordinary (0) strings, a bounded sample of each. The sample of
    documents is the one with the smallest digests of text, so it doesn't depend on their order; only
    digests are ordered, never texts."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    digests = docs.select(F.xxhash64(text).alias("h")).distinct().orderBy("h").limit(SAMPLE_DOCS)
    last = digests.agg(F.max("h")).first()[0]
    sample = docs.select(text.alias("text")).where(F.xxhash64("text") <= F.lit(last).cast("long")).distinct()
    spans = sample.select("text", F.concat(*base_spans(F.col("text"))).alias("spans"))
    values = spans.select(F.explode("spans.value").alias("s")).where(F.col("s").rlike("^[ -~]+$"))
    digest = F.sha2(F.col("id").cast("string"), 256)
    plain = lambda bits: F.translate(F.base64(F.unhex(F.sha2(digest, bits))), "=", "")
    made = spark.range(1000).select(F.explode(F.array(digest, plain(256), plain(512), F.upper(plain(384)))).alias("s"))
    outside = spans.where(F.size("spans") == 0).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z0-9_]{6,}"), F.lit(0))).alias("s"))
    first = lambda df, label: df.distinct().orderBy(F.xxhash64("s"), "s").limit(SAMPLE_STRINGS).select(F.lit(label).alias("label"), "s")
    return first(values.union(made), 1).union(first(outside, 0))


def ratios(counts: list[tuple[int, int, int]]) -> list[float]:
    """log P(b | a, random) - log P(b | a, ordinary) by pair code, with add-one smoothing over the
    characters that occur."""
    n = {0: {}, 1: {}}
    for label, pair, count in counts:
        n[label][pair] = count
    after = {k: [sum(t.get(a * CODES + b, 0) for b in range(CODES)) for a in range(CODES)] for k, t in n.items()}
    size = max(2, len({p % CODES for t in n.values() for p in t}))
    log = lambda k, p: math.log((n[k].get(p, 0) + 1) / (after[k][p // CODES] + size))
    return [round(log(1, p) - log(0, p), 5) for p in range(CODES * CODES)]


def train(docs: DataFrame) -> list[float]:
    """The table of log-likelihood ratios by pair, learned from docs. At most 2 * CODES ** 2 counts
    reach the driver."""
    return ratios([(r["label"], r["pair"], r["n"]) for r in _pairs(training_strings(docs)).collect()])


def mean_ratio(s: Column, table: list[float]) -> Column:
    """Mean log-likelihood ratio of the pairs of s, which has two characters or more."""
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<double>")
    add = lambda a, b: a + b
    of_block = lambda block: F.aggregate(F.transform(pair_codes(block), lambda p: F.element_at(values, p + 1)), F.lit(0.0), add)
    several = F.filter(pair_blocks(s), lambda x: F.length(x) >= 2)
    return F.aggregate(F.transform(several, of_block), F.lit(0.0), add) / (F.length(s) - 1)


def markov_spans(text: Column, table: list[float], threshold: float = THRESHOLD, threshold_letters: float = THRESHOLD_LETTERS) -> Column:
    """Long runs that the random model explains better, by a wider margin if they have no digit."""
    runs = none_or(RUN, text, match_spans(text, RUN, MARKOV, len(KINDS)))
    least = lambda x: F.when(x["value"].rlike("[0-9]"), threshold).otherwise(threshold_letters)
    return F.filter(runs, lambda x: mean_ratio(x["value"], table) > least(x))


def with_spans(docs: DataFrame, base: str, spans: str, table: list[float] | None = None) -> DataFrame:
    """docs with a column of base spans (array of arrays by kind) and one of all spans in order of
    start and kind. A null text has none."""
    table = train(docs) if table is None else table
    text = F.coalesce("text", F.lit(""))
    kept = docs.withColumn(base, F.array(*base_spans(text)))
    return kept.withColumn(spans, F.array_sort(F.concat(F.flatten(base), markov_spans(text, table))))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, table: list[float] | None = None) -> DataFrame:
    """One row per row of docs (doc_id, text): counts of base kinds, digest of the base spans, all
    spans. Null texts are empty, null ids and repeated rows are kept, texts of any length and with any
    number of matches are scanned whole, an empty table gives an empty
    result; columns of docs with other names are not read."""
    found = with_spans(docs.select("doc_id", "text"), "_base", "_spans", table)
    counts = [F.size(F.col("_base")[i]).cast("long").alias(f"n_{kind}") for i, (kind, *_) in enumerate(KINDS)]
    base = F.sha2(written(F.array_sort(F.flatten("_base"))), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, written(F.col("_spans")).alias("spans"))


def redact(docs: DataFrame, table: list[float] | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with each stretch of text that spans cover replaced by mark; overlapping spans count as
    one stretch, however long the text. Texts without spans, null ones too, stay as they are, as do all other columns; n_chars follows the text."""
    base, spans = free_name(docs, "base_spans"), free_name(docs, "spans")
    found = with_spans(docs, base, spans, table)
    text = F.coalesce("text", F.lit(""))

    def piece(parts: Column, start: Column, end: Column) -> Column:
        """The text from start up to end, from its blocks."""

        def of_block(k: Column) -> Column:
            low = F.greatest(start - k * BLOCK, F.lit(0))
            return F.substring(F.get(parts, k), low + 1, F.least(end - k * BLOCK, F.lit(BLOCK)) - low)

        at = lambda x: F.floor(x / BLOCK).cast("int")
        return F.when(end > start, F.array_join(F.transform(F.sequence(at(start), at(end - 1)), of_block), "")).otherwise("")

    def cut(parts: Column, xs: Column) -> Column:
        # covered: up to where the spans before each reach
        covered = running(F.transform(xs, lambda x: x["end"]), lambda a, b: F.greatest(a, b))
        marked = lambda x, before: F.when(x["start"] >= before, F.concat(piece(parts, before, x["start"]), F.lit(mark))).otherwise("")
        rest = piece(parts, F.array_max(F.transform(xs, lambda x: x["end"])), F.length(text))
        return F.concat(F.array_join(F.zip_with(xs, covered, marked), ""), rest)

    changed = F.size(spans) > 0
    redacted = let(blocks(text), lambda parts: let(F.col(spans), lambda xs: cut(parts, xs)))
    out = found.withColumn("text", F.when(changed, redacted).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
