"""Merkle manifest of a dataset: leaves, subtrees by language, one root, and a proof for each row.

Leaves are ranked within their language. Blocks of WIDTH ** DIGITS consecutive leaves are rolled up
by grouping their rank's digits away one after the other, the nodes of a digit nesting the structs of
its children; a block is one row of bounded size, and a transform over the nested structs and an explode tell every leaf's
siblings without a join inside the block. Roots of blocks are leaves of the next roll-up, and so are roots
of languages; what a block's root has above it is joined once, a row a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logquill.llm.common import stored

#: Children of a node, and digits of a rank that a block holds.
WIDTH, DIGITS = 8, 3
#: A step of a proof: what is hashed before and after the node, as hex text.
STEP = "struct<before: string, after: string>"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def told(value: Column) -> Column:
    """A leaf's input: "-" for null, or else the count of UTF-8 bytes, ":" and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaves(docs: DataFrame) -> DataFrame:
    """(lang, doc_id, leaf, tampered): tampered is the leaf with A-Z of the text in lower case where 3 divides
    the CRC-32 of the decimal doc_id, else null. Other columns of docs are left out."""

    def leaf(text: Column) -> Column:
        return digest(F.concat(*(told(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")), told(text)))

    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    return docs.select("lang", "doc_id", leaf(F.col("text")).alias("leaf"), F.when(chosen, leaf(F.translate("text", CAPITALS, SMALL))).alias("tampered"))


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """df with its row's rank in its group, from 0, and the group's size; nulls come first. Rows are dealt by
    ranges of (group, order) and counted by range and group, so a group of any size is spread."""
    cols = [F.col(c).asc_nulls_first() for c in (group, *order)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()
    dealt = stored(df.repartitionByRange(n, *cols).sortWithinPartitions(*cols).select("*", F.shiftright(place, 33).alias("part"), place.alias("place")), "manifest-ranges")
    counts = dealt.groupBy(group, "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(F.col(group).alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("offset"), F.sum("n").over(Window.partitionBy(group)).alias("size"))
    found = dealt.join(offsets, dealt[group].eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return found.select(*df.columns, (F.col("place") + F.col("offset")).alias("rank"), "size")


def levels_of(size: Column) -> Column:
    """How often size nodes are grouped until one remains."""
    return sum(((size > WIDTH**k).cast("int") for k in range(21)), F.lit(0))


def roll_up(nodes: DataFrame) -> DataFrame:
    """Blocks (g, block, levels, left, hash, tree) of nodes (g, rank, levels, hash, row): tree nests arrays of
    (digit, hash, below) DIGITS deep, with row at the bottom; left is how many levels of its group a block has above it. Rows
    are dealt by (g, block) once, and all digits are grouped away where they are."""
    digits = [(F.floor(F.col("rank") / WIDTH**k) % WIDTH).cast("int").alias(f"d{k}") for k in range(DIGITS)]
    block = F.floor(F.col("rank") / WIDTH**DIGITS).alias("block")
    level = nodes.select("g", block, "levels", *digits, "hash", F.col("row").alias("below")).repartition("g", "block")
    for k in range(DIGITS):
        kept = ["g", "block", "levels", *(f"d{i}" for i in range(k + 1, DIGITS))]
        level = level.groupBy(*kept).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{k}").alias("digit"), "hash", "below"))).alias("below"))
        joined = F.array_join(F.transform("below", lambda x: x["hash"]), "")
        level = level.withColumn("hash", F.when(F.col("levels") > k, digest(joined)).otherwise(F.col("below")[0]["hash"]))
    return level.select("g", "block", F.greatest(F.col("levels") - DIGITS, F.lit(0)).alias("left"), "levels", "hash", F.col("below").alias("tree"))


def _step(run: Column, at: Column) -> Column:
    hashes = F.transform(run, lambda x: x["hash"])
    return F.struct(F.array_join(F.slice(hashes, 1, at), "").alias("before"), F.array_join(F.slice(hashes, at + 2, WIDTH), "").alias("after"))


def _paths(tree: Column, depth: int, above: list[Column]) -> Column:
    """An array of (row, hash, steps) of all leaves of a tree, steps from the leaf up."""

    def below(x: Column, i: Column) -> Column:
        steps = [_step(tree, i), *above]
        if depth == 1:
            return F.struct(x["below"].alias("row"), x["hash"].alias("hash"), F.array(*steps).alias("steps"))
        return _paths(x["below"], depth - 1, steps)

    out = F.transform(tree, below)
    return out if depth == 1 else F.flatten(out)


def told_proofs(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """(g, row, hash, subroot, root, steps) of all nodes in blocks; above: what above() says of the blocks."""
    joined = blocks.join(above, blocks["g"].eqNullSafe(above["ag"]) & (blocks["block"] == above["ablock"]))
    found = joined.select("g", "levels", "subroot", "root", "more", F.explode(_paths(F.col("tree"), DIGITS, [])).alias("x"))
    return found.select("g", "x.row", "x.hash", "subroot", "root", F.concat(F.slice("x.steps", 1, F.least("levels", F.lit(DIGITS))), "more").alias("steps"))


def above(blocks: DataFrame, top: bool = False) -> DataFrame:
    """(ag, ablock, subroot, root, more): the root of each block's group, the root of all, and the steps up to it.

    Blocks are rolled up as long as a group has several of them; then groups' roots are, as one group."""
    none = F.array().cast(f"array<{STEP}>")
    several = bool(blocks.agg(F.max("block")).first()[0])
    if top and not several:
        return blocks.select(F.col("g").alias("ag"), F.col("block").alias("ablock"), F.col("hash").alias("subroot"), F.col("hash").alias("root"), none.alias("more"))
    if several:
        nodes = blocks.select("g", F.col("block").alias("rank"), F.col("left").alias("levels"), "hash", F.struct(F.col("g").alias("ag"), F.col("block").alias("ablock")).alias("row"))
    else:
        roots = ranked(blocks.select("hash", F.lit(0).alias("all"), F.col("g").alias("ag"), F.col("block").alias("ablock")), "all", "ag")
        nodes = roots.select(F.col("all").alias("g"), "rank", levels_of(F.col("size")).alias("levels"), "hash", F.struct("ag", "ablock").alias("row"))
    upper = stored(roll_up(nodes), "manifest-blocks")
    found = told_proofs(upper, above(upper, top or not several))
    subroot = F.col("subroot" if several else "hash").alias("subroot")
    return stored(found.select("row.ag", "row.ablock", subroot, "root", F.col("steps").alias("more")), "manifest-above")


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of docs (doc_id, source, lang, n_chars, text).

    Nulls are told as "-"; rows without lang are a group of their own, the first one; rows without doc_id
    come first in theirs and aren't tampered with. Rows that repeat a doc_id are ordered by their leaves.
    Empty and very long texts are hashed whole. An empty table gives an empty result; other columns are left
    out, whatever their names. Texts are read once; leaves are written, and all that follows has a row of some
    hundred bytes a document, or one a block of 512 of them. Proofs themselves are told and hashed row by
    row and never written."""
    order = ranked(stored(leaves(docs), "manifest-leaves"), "lang", "doc_id", "leaf")
    nodes = order.select(F.col("lang").alias("g"), "rank", levels_of(F.col("size")).alias("levels"), F.col("leaf").alias("hash"), F.struct("doc_id", "tampered").alias("row"))
    blocks = stored(roll_up(nodes), "manifest-blocks")
    found = told_proofs(blocks, above(blocks))
    proof = digest(F.array_join(F.transform("steps", lambda s: F.concat(s["before"], s["after"])), ""))
    folded = F.aggregate("steps", F.coalesce("row.tampered", "hash"), lambda h, s: digest(F.concat(s["before"], h, s["after"])))
    out = found.select("row.doc_id", F.col("hash").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
