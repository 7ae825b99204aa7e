"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Every text gives its set of 5-word shingle hashes, a signature and a digest of the set. Texts
   with one digest are one class from there on, so exact copies never multiply.
2. Several trees each order the signature's values in their own way. Classes are sorted by each
   tree's order; those with a common prefix of MIN_DEPTH values or more form a region. A small
   region gives all its pairs. A large one is descended, level by level, to where it is small; at
   each level its members meet their neighbours in the order. So depth adapts to how crowded a
   region is. Besides, the members of a large region meet its hubs: those that lie on the heaviest
   branch in most trees, which in a group of many altered copies are the least altered ones. So
   candidates grow with the number of classes, not with its square.
3. Pairs whose signatures or set sizes rule the threshold out go. The best few partners of each class
   are confirmed first, on full sets; then every remaining pair that would join two components.
   A pair inside a component can't change it.
4. Regions over SMALL whose members are still in several components are settled exactly: the classes
   of their components form clusters, and there all pairs of different components whose sizes allow
   a link are counted on full sets, in blocks of bounded size. The least work that is left to such a
   cluster is its classes outside its largest component times all its classes.
5. Components come from alternating large-star and small-star steps. Nothing but counters of
   convergence reaches the driver.

Range partitioning by (key, class) deals even one crowded region over tasks; what lies on either
side of a boundary, as far as a small region reaches, is matched in a second small step.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logquill.llm.common import free_name, slices, stored

SHINGLE, PERCENT = 5, 75
TREES, MIN_DEPTH, DEPTH = 24, 4, 10
VALUES = TREES * MIN_DEPTH
#: Regions of that size or less give all their pairs; neighbours and hubs of larger ones.
SMALL, NEIGHBOURS, HUBS = 8, 2, 4
#: Keys of one region that a task holds at a time, parts in which hubs are ranked, sets that a task remembers.
HELD, SALTS, REMEMBERED = 200_000, 32, 65_536
#: Partners of each class that are confirmed first.
FIRST = 3
#: Classes and shingles of a block of a cluster, about; dense columns multiplied and pairs counted at a time.
BLOCK, BLOCK_SHINGLES, COLUMNS_AT_A_TIME, PAIRS_AT_A_TIME = 2048, 1 << 20, 512, 1 << 18
#: Classes of each side of a block that are counted at a time, which bounds a task's memory.
SIDE = 1024
#: Share of equal signature values that a pair needs: 4.5 standard deviations below the threshold.
LEAST_ALIKE = 0.55
ROWS = "doc_id long, text_key binary, n_shingles long, node binary, signature binary"


def shingle_hashes(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; of all its words if they are fewer
    than SHINGLE; none without words. Words are cut at ASCII white space, A-Z in lower case."""
    import xxhash

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(SHINGLE, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[k : len(words) - size + 1 + k]
    mixed = (mixed ^ (mixed >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(mixed ^ (mixed >> np.uint64(31)))


_RANDOM = np.random.default_rng(17)
_FACTORS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _RANDOM.integers(0, 1 << 63, VALUES, dtype=np.uint64)
#: The values of each tree in its order: MIN_DEPTH of its own first, then others.
_ORDERS = np.array([[*range(t * MIN_DEPTH, (t + 1) * MIN_DEPTH), *((t * MIN_DEPTH + MIN_DEPTH + np.random.default_rng(t).permutation(VALUES - MIN_DEPTH)) % VALUES)[: DEPTH - MIN_DEPTH]] for t in range(TREES)])


def signature(hashes: np.ndarray) -> np.ndarray:
    """VALUES 16-bit digests of the least value of each hash function."""
    least = np.full(VALUES, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[start : start + 2048, None] * _FACTORS + _OFFSETS).min(axis=0))
    return ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(">u2")


def with_signatures(docs: DataFrame) -> DataFrame:
    """ROWS of docs (doc_id, text); node and signature are null where there are no words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            n, nodes, signatures = [], [], []
            for text in batch["text"].to_pylist():
                hashes = shingle_hashes(text)
                n.append(len(hashes))
                nodes.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None)
                signatures.append(signature(hashes).tobytes() if len(hashes) else None)
            yield pa.record_batch([batch["doc_id"], batch["text_key"], pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "text_key", "n_shingles", "node", "signature"])

    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.unhex(F.md5(text)).alias("text_key")).mapInArrow(sign, ROWS)


def forest(classes: DataFrame) -> DataFrame:
    """key (tree and its values in order) and node, a row for each class and tree."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2048):
            values = np.frombuffer(b"".join(batch["signature"].to_pylist()), ">u2").reshape(-1, VALUES)
            out = []
            for tree, order in enumerate(_ORDERS):
                data = np.hstack([np.full((len(values), 1), tree, np.uint8), np.ascontiguousarray(values[:, order]).view(np.uint8)])
                out += [row.tobytes() for row in data]
            yield pa.record_batch([pa.array(out, pa.binary()), pa.array(batch["node"].to_pylist() * TREES, pa.binary())], names=["key", "node"])

    return classes.select("node", "signature").mapInArrow(keys, "key binary, node binary")


def common_depth(keys: np.ndarray) -> np.ndarray:
    """How many leading values each key shares with the one before; 0 for another tree's."""
    same = keys[1:] == keys[:-1]
    levels = np.concatenate([same[:, :1], same[:, 1::2] & same[:, 2::2]], axis=1)
    return np.concatenate([[0], np.maximum(np.cumprod(levels, axis=1).sum(axis=1) - 1, 0)])


def region_pairs(shared: np.ndarray) -> tuple[set[tuple[int, int]], list[tuple[int, int, int, int]]]:
    """Pairs of positions to compare, for sorted keys whose depth shared with the one before is
    `shared`; and the large regions with their heaviest branches (start, end, start, end)."""
    out: set[tuple[int, int]] = set()
    large: list[tuple[int, int, int, int]] = []
    bounds = [0, *np.flatnonzero(shared[1:] < MIN_DEPTH) + 1, len(shared)]
    todo = [(int(a), int(b), MIN_DEPTH) for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1]
    while todo:
        a, b, depth = todo.pop()
        if b - a <= SMALL:
            out |= {(i, j) for i in range(a, b) for j in range(i + 1, b)}
            continue
        for step in range(1, NEIGHBOURS + 1):
            out |= {(i, i + step) for i in range(a, b - step)}
        low, high = a, b
        for level in range(depth, DEPTH):
            cuts = [low, *(low + 1 + np.flatnonzero(shared[low + 1 : high] <= level)).tolist(), high]
            if level == depth:
                todo += [(c, e, depth + 1) for c, e in zip(cuts, cuts[1:], strict=False) if e - c > 1]
                if depth > MIN_DEPTH:
                    break
            k = int(np.argmax(np.diff(cuts)))
            if cuts[k + 1] - cuts[k] < 2:
                break
            low, high = cuts[k], cuts[k + 1]
        if depth == MIN_DEPTH:
            large.append((a, b, low, high))
    return out, large


FOUND = "kind string, a binary, b binary, key binary, heavy boolean"


def search_forest(sorted_keys: DataFrame) -> DataFrame:
    """Rows of kind pair (a, b) from each partition, end (a, key) for what lies next to its ends, and
    member (a, key of its region, heavy) for large regions and for those that may go on in another
    partition.

    A region of more than HELD keys is handled in stretches that share SMALL keys, so that every pair
    of the whole is in one of them. Only `heavy`, a hint for choosing hubs, is told by stretch."""
    size = 1 + 2 * MIN_DEPTH

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head: list[tuple] = []
        keys: list[bytes] = []
        nodes: list[bytes] = []
        ended = True  # no stretch yet

        def rows(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.bool_())
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["kind", "a", "b", "key", "heavy"])

        def flush(until: int, first: bool, last: bool) -> pa.RecordBatch:
            shared = common_depth(np.frombuffer(b"".join(keys[:until]), np.uint8).reshape(until, -1))
            pairs, large = region_pairs(shared)
            found = [("pair", min(nodes[i], nodes[j]), max(nodes[i], nodes[j]), None, None) for i, j in pairs]
            breaks = np.flatnonzero(shared[1:] < MIN_DEPTH) + 1
            outer = [(0, int(breaks[0]) if len(breaks) else until)] * first + [(int(breaks[-1]) if len(breaks) else 0, until)] * last
            for a, b, low, high in [*large, *((a, b, a, a) for a, b in outer if all(x[:2] != (a, b) for x in large))]:
                found += [("member", nodes[i], None, keys[i][:size], low <= i < high) for i in range(a, b)]
            return rows(list(dict.fromkeys(found)))

        for batch in batches:
            keys += batch["key"].to_pylist()
            nodes += batch["node"].to_pylist()
            if len(head) < SMALL:
                head = [("end", n, None, k, None) for n, k in zip(nodes[:SMALL], keys[:SMALL], strict=True)]
            # a region goes on into the next batch: hold it back, unless it fills the memory's share
            until = next((i for i in range(len(keys) - 1, 0, -1) if keys[i][:size] != keys[i - 1][:size]), 0)
            if until:
                yield flush(until, ended, False)
                keys, nodes, ended = keys[until:], nodes[until:], False
            if len(keys) > HELD:
                yield flush(len(keys), ended, False)
                keys, nodes, ended = keys[-SMALL:], nodes[-SMALL:], False
        if keys:
            yield flush(len(keys), ended, True)
            tail = [("end", n, None, k, None) for n, k in zip(nodes[-SMALL:], keys[-SMALL:], strict=True)]
            yield rows(head + [x for x in tail if x not in head])

    return sorted_keys.mapInArrow(find, FOUND)


def across_ends(found: DataFrame) -> DataFrame:
    """(a, b) of keys of one region that a boundary between partitions parts, up to as far from each
    other as a small region reaches. There are a few rows for each partition."""
    ends = found.where("kind = 'end'").select(F.substring("key", 1, 1 + 2 * MIN_DEPTH).alias("region"), "key", F.col("a").alias("node"))
    near = Window.partitionBy("region").orderBy("key", "node")
    others = F.array(*(F.lead("node", k).over(near) for k in range(1, SMALL)))
    pairs = ends.withColumn("others", others).select("node", F.explode("others").alias("other")).where(F.col("other").isNotNull() & (F.col("node") != F.col("other")))
    return pairs.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b"))


def with_hubs(found: DataFrame) -> DataFrame:
    """(a, b) of each member of a large region and the region's hubs, which are ranked in salted
    parts of a region first."""
    members = found.where("kind = 'member'").select(F.col("a").alias("node"), F.col("key").alias("region"), "heavy").distinct()
    central = members.groupBy("node").agg(F.count_if("heavy").alias("trees"))
    order = [F.desc("trees"), F.col("node")]
    salted = members.select("region", "node").distinct().join(central, "node").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)))
    some = salted.withColumn("place", F.row_number().over(Window.partitionBy("region", "salt").orderBy(*order))).where(F.col("place") <= HUBS)
    ranked = some.withColumn("place", F.row_number().over(Window.partitionBy("region").orderBy(*order))).where(F.col("place") <= HUBS)
    hubs = stored(ranked.groupBy("region").agg(F.collect_list("node").alias("hubs")), "hubs")
    pairs = members.join(hubs, "region").select("node", F.explode("hubs").alias("hub")).where("node <> hub")
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def candidates(found: DataFrame) -> DataFrame:
    """Distinct (a, b), a < b, of the forest's candidates."""
    return found.where("kind = 'pair'").select("a", "b").union(across_ends(found)).union(with_hubs(found)).distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """a, b and the share of equal signature values, of the pairs that may pass."""
    side = lambda n: classes.select(F.col("node").alias(n), F.col("signature").alias(f"s{n}"), F.col("n_shingles").alias(f"n{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            left, right = (np.frombuffer(b"".join(batch[c].to_pylist()), ">u2").reshape(-1, VALUES) for c in ("sa", "sb"))
            alike = (left == right).mean(axis=1)
            out = pa.record_batch([batch["a"], batch["b"], pa.array(alike)], names=["a", "b", "alike"])
            yield out.filter(pa.array(alike >= LEAST_ALIKE))

    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a binary, b binary, alike double")


def shingle_sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and full set (sorted 64-bit hashes) of every class in nodes, from the text of one of its
    documents."""
    wanted = nodes.select("node").distinct().join(classes, "node").select("text_key", F.col("rep").alias("doc_id"), F.col("node").alias("of"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("id"), text.alias("text"), F.unhex(F.md5(text)).alias("key"))
    found = rows.join(wanted, rows["id"].eqNullSafe(wanted["doc_id"]) & (rows["key"] == wanted["text_key"])).select("of", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, None] = {}  # of repeated rows; a set that is given again is harmless
        for batch in slices(batches):
            rows = {n: t for n, t in zip(batch["of"].to_pylist(), batch["text"].to_pylist(), strict=True) if n not in seen}
            seen |= dict.fromkeys(rows)
            if len(seen) > REMEMBERED:
                seen = dict.fromkeys(list(seen)[-REMEMBERED // 2 :])
            data = [shingle_hashes(t).tobytes() for t in rows.values()]
            yield pa.record_batch([pa.array(rows.keys(), pa.binary()), pa.array(data, pa.binary())], names=["node", "hashes"])

    return found.mapInArrow(sets, "node binary, hashes binary")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) whose full sets meet the threshold."""
    side = lambda n: sets.select(F.col("node").alias(n), F.col("hashes").alias(f"s{n}"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            keep = []
            for left, right in zip(batch["sa"].to_pylist(), batch["sb"].to_pylist(), strict=True):
                x, y = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield pa.record_batch([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb").mapInArrow(test, "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """node and root, the least node of its component, of every node in links (a, b)."""
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def least(e: DataFrame) -> DataFrame:
        # written, so that both sides of the join are plain exchanges, which Spark can split
        return stored(e.groupBy("u").agg(F.min("v").alias("m")), "least")

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())

    before = None
    while (now := state(edges)) != before:
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("m", "u").alias("m"))
        large = both.join(m, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = stored(large, "large-star")
        m = least(large)
        small = large.join(m, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stored(small.union(m.select("u", F.col("m").alias("v"))).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small-star")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def _rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs with the component of each end (the node itself where it has no link)."""
    side = lambda n: roots.select(F.col("node").alias(n), F.col("root").alias(f"r{n}"))
    out = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return out.withColumns({f"r{n}": F.coalesce(f"r{n}", n) for n in "ab"})


def raised(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root), with the components that links (a, b) join made one."""
    joined = _rooted(links, roots).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    upper = stored(components(joined), "upper-roots").select(F.col("node").alias("root"), F.col("root").alias("top"))
    alone = links.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(roots, "node", "left_anti").select("node", F.col("node").alias("root"))
    return roots.union(alone).join(upper, "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def clusters(found: DataFrame, roots: DataFrame) -> DataFrame:
    """root and cluster of every component that shares a large region with another component; regions
    with a common component are in one cluster."""
    members = found.where("kind = 'member'").select(F.col("a").alias("node"), F.col("key").alias("region")).join(roots, "node", "left")
    members = stored(members.select("region", F.coalesce("root", "node").alias("root")).distinct(), "members")
    open_regions = members.groupBy("region").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most")
    links = members.join(stored(open_regions.select("region", "least"), "open-regions"), "region").select(F.col("root").alias("a"), F.col("least").alias("b"))
    return components(links).select(F.col("node").alias("root"), F.col("root").alias("cluster"))


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of left has in common with each of right."""
    rows = [np.repeat(np.arange(len(sets)), [len(x) for x in sets]) for sets in (left, right)]
    _, token = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    tokens = [token[: len(rows[0])], token[len(rows[0]) :]]
    n = [np.bincount(t, minlength=len(token)) for t in tokens]
    work = n[0] * n[1]
    out = np.zeros((len(left), len(right)), np.float32)  # counts below 2 ** 24 are exact
    # shingles in many sets of both sides are multiplied, others paired one by one
    dense = work > out.size / 64
    place = np.cumsum(dense) - 1
    picked = [dense[t] for t in tokens]
    cells = [(place[t[k]], r[k]) for t, r, k in zip(tokens, rows, picked, strict=True)]
    for start in range(0, int(dense.sum()), COLUMNS_AT_A_TIME):
        sides = []
        for (column, row), size in zip(cells, out.shape, strict=True):
            here = (column >= start) & (column < start + COLUMNS_AT_A_TIME)
            side = np.zeros((size, COLUMNS_AT_A_TIME), np.float32)
            side[row[here], column[here] - start] = 1
            sides.append(side)
        out += sides[0] @ sides[1].T
    rare = [np.flatnonzero(~dense[t] & (work[t] > 0)) for t in tokens]
    order = rare[1][np.argsort(tokens[1][rare[1]], kind="stable")]
    first = np.searchsorted(tokens[1][order], tokens[0][rare[0]])
    times = n[1][tokens[0][rare[0]]]
    upto = np.cumsum(times)
    start = 0
    while start < len(times):
        end = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS_AT_A_TIME, "right")))
        t = times[start:end]
        at = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(first[start:end], t)
        np.add.at(out, (np.repeat(rows[0][rare[0][start:end]], t), rows[1][order[at]]), np.float32(1))
        start = end
    return out


def links_of_block(left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, b) of roots: as many of the links between classes (root, hashes) of left and right as join
    all components that any link joins."""
    pairs = []
    if len(left) and len(right):
        sets = [[np.frombuffer(x, np.uint64) for x in side["hashes"].to_pylist()] for side in (left, right)]
        names, code = np.unique(np.array(left["root"].to_pylist() + right["root"].to_pylist(), object), return_inverse=True)
        sizes = [np.array([len(x) for x in side]) for side in sets]
        label = np.arange(len(names))
        rows = (row for a in range(0, len(left), SIDE) for row in np.hstack([shared_counts(sets[0][a : a + SIDE], sets[1][b : b + SIDE]) for b in range(0, len(right), SIDE)]))
        for i, row in enumerate(rows):
            both = row.astype(np.int64)
            linked = 100 * both >= PERCENT * (sizes[0][i] + sizes[1] - both)
            for c in np.unique(code[len(left) :][linked]):
                own, other = label[code[i]], label[c]
                if own != other:
                    pairs.append((names[code[i]], names[c]))
                    label[label == other] = own
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def settled(docs: DataFrame, classes: DataFrame, roots: DataFrame, of: DataFrame) -> DataFrame:
    """(a, b) of roots that links between components of one cluster join, from all pairs of classes.

    The classes of a cluster are dealt, by size, over units of bounded length; a unit meets those in
    which a set may be large and small enough. Classes of a cluster's largest component don't meet
    each other."""
    rows = classes.select("node", "n_shingles").join(roots, "node", "left").select("node", "n_shingles", F.coalesce("root", "node").alias("root")).join(of, "root")
    counts = rows.groupBy("cluster", "root").agg(F.count("*").alias("n"))
    largest = stored(counts.groupBy("cluster").agg(F.max_by("root", F.struct("n", "root")).alias("largest")), "largest")
    # sizes that a link allows differ by a factor of 100 / PERCENT at most, so by one step of size
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / PERCENT))).alias("step")
    rows = stored(rows.join(largest, "cluster").select("node", "root", "cluster", (F.col("root") == F.col("largest")).alias("main"), step, "n_shingles"), "crowded")
    unit = ["cluster", "main", "step"]
    parts = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("parts")
    units = stored(rows.groupBy(unit).agg(parts), "units")
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part")
    sets = shingle_sets(docs, classes, rows)
    dealt = stored(rows.join(units, unit).select("node", "root", *unit, part).join(sets, "node").drop("node"), "dealt")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
    every = units.select(*unit, each)
    lefts = every.where("NOT main").select("cluster", F.col("step").alias("lstep"), F.col("part").alias("lpart"))
    near = (F.abs(F.col("step") - F.col("lstep")) <= 1) & (F.col("main") | (F.struct("step", "part") >= F.struct("lstep", "lpart")))
    blocks = stored(lefts.join(every, "cluster").where(near), "blocks")
    key = ["cluster", "lstep", "lpart", "main", "step", "part"]
    left = dealt.where("NOT main").select("cluster", F.col("step").alias("lstep"), F.col("part").alias("lpart"), "root", "hashes").join(blocks, ["cluster", "lstep", "lpart"])
    right = dealt.join(blocks, ["cluster", "main", "step", "part"])
    # new names of the same columns, since both sides come from one table
    names = lambda n: [f"{c}_{n}" for c in key]
    side = lambda of, n: of.select(*key, "root", "hashes").toDF(*names(n), "root", "hashes").groupBy(*names(n))
    return side(left, "l").cogroup(side(right, "r")).applyInArrow(links_of_block, "a binary, b binary")


def linked_classes(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """node and root of every class with a link to another."""
    ordered = forest(classes).repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    found = stored(search_forest(ordered), "forest")
    pairs = stored(likely(candidates(found), classes), "likely")
    sets = stored(shingle_sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("node"))), "sets")
    either = pairs.union(pairs.select("b", "a", "alike")).toDF("node", "other", "alike")
    best = Window.partitionBy("node").orderBy(F.desc("alike"), "other")
    first = either.withColumn("place", F.row_number().over(best)).where(F.col("place") <= FIRST).select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    links = stored(confirmed(first, sets), "first-links")
    roots = stored(components(links), "roots")
    open_pairs = _rooted(pairs.join(first, ["a", "b"], "left_anti"), roots).where("ra <> rb")
    roots = stored(raised(roots, stored(confirmed(open_pairs, sets), "more-links")), "forest-roots")
    of = stored(clusters(found, roots), "clusters")
    if of.isEmpty():
        return roots
    return raised(roots, stored(settled(docs, classes, roots, of), "last-links"))


def near_duplicates(docs: DataFrame, with_text_key: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    Texts link if 100 * |A & B| >= 75 * |A | B| for their sets of shingles; a component's id is its
    smallest doc_id and its document with that id is kept. Null texts and texts without words have
    no shingles and are their own component; null ids are smaller than none: such a row is kept only
    if its whole component has no id. Repeated rows share their fate; texts of any length count whole; an empty table gives an empty
    result; other columns are not read. with_text_key adds the MD5 of the text."""
    rows = stored(with_signatures(docs), "signatures")
    one = F.min_by(F.struct("doc_id", "text_key"), F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("one")
    classes = rows.where(F.col("node").isNotNull()).groupBy("node").agg(one, F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"))
    classes = stored(classes.select("node", F.col("one.doc_id").alias("rep"), F.col("one.text_key").alias("text_key"), "n_shingles", "signature"), "classes")
    roots = stored(linked_classes(docs, classes), "linked")
    tops = classes.select("node", "rep").join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "rep")
    tops = stored(tops, "tops")
    ids = stored(tops.groupBy("root").agg(F.min("rep").alias("component_id")), "ids")
    of = tops.join(ids, "root").select("node", "component_id")
    out = rows.join(stored(of, "components"), "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    columns = ["doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")]
    return out.select(*columns, *(["text_key"] if with_text_key else []))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: one document of each component, all columns as they were. Of rows with the same doc_id and
    text one stays, whichever."""
    kept = near_duplicates(docs, with_text_key=True).where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_key").alias("kept_key")).agg(F.count("*").alias("n"))
    kept = stored(kept, "kept")
    own = free_name(docs, "text_key")
    keyed = docs.withColumn(own, F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = keyed["doc_id"].eqNullSafe(kept["kept_id"]) & (keyed[own] == kept["kept_key"])
    of = lambda rows: keyed.join(rows, same, "left_semi")
    once, again = of(kept.where("n = 1")), kept.where("n > 1")
    # only rows that repeat are brought together
    out = once if again.isEmpty() else once.union(of(again).dropDuplicates(["doc_id", own]))
    return out.select(*docs.columns)
