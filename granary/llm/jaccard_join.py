"""Operator 6: Jaccard similarity join on word shingles, by chosen paths.

Documents are sets of five-word shingles (words: text between white space; a shorter document is one
shingle of all its words; one without words is similar to nothing).  Result: for each document its
class (the least document id among those connected by links) and its number of links (other documents of similarity
``threshold`` or more).

Method.  Documents of equal sets are one node with a number of copies.  A path is a sequence of
sampled tokens that a set holds.  Each root is one run of the recursion: it samples one token of a set in the mean (each token of a
set of n with probability ``runs`` / n for all runs together, by one hash for all sets, so similar sets sample the same tokens), and
runs are repeated until the target recall is met (``runs_for``); all runs go through the same plan at once.  Nodes that share a path meet
in its bucket.  A bucket of up to ``block`` nodes is compared by brute
force.  A larger one is split again: each path samples ``branches`` further tokens of each set, by a hash of
its own, from a pool of ``pool`` tokens sampled alike for all sets; sets that share few tokens part at every level.
A bucket that is dense (its nodes share most of their samples), or large at the last level, is compared
by brute force in pairs of blocks.  Nothing is dropped for size.

Brute force goes in two passes.  First pools alone are compared: a node without any partner of estimated similarity
``loose`` leaves the bucket, and a bucket falls into the components of what is left; equal sets of members become
one bucket, and a bucket whose nodes all have one larger bucket in common gives way to it.  Then the whole sets of the rest are
compared, each sent once to each bucket that is left, as 32-bit tokens (chance collisions move a similarity by about n / 2^32).
A bucket is cut into blocks by the number of its nodes and by the sum of its sets.  The estimate: the pool of the larger set of a pair
is sampled at the smaller rate, so what the pools share is what the smaller set holds of it; that share of
the pool stands for the share of the larger set, and the sizes are known.

Recall.  A pair of similarity 0.8 has 0.8 ``runs`` common paths on level 1 in the mean (12.8 of 16), and keeps each on
a further level with probability 0.8, independently: it is lost with probability at most 3e-6 at level 1, 4e-5, 1e-4
and 2e-4 if all common buckets are so large that two, three, four levels are needed; less above 0.8.  Sets of up to
16 have fewer common roots (4 of 5) and one branch more: at most 1e-6 for them.  The pool pass
is the same in all buckets and adds at most 4e-10: for a pair of 0.8 whose one set contains the other, a share of 0.42
(similarity 0.3) of the larger pool instead of 0.8 is over seven standard deviations off; equal sizes are further off.

Cost.  Links are counted where they are found, at the least bucket that both nodes have in common, so no pair is
counted twice and none leaves its task: a bucket returns a count a node and a star of edges a component.
Components are found by alternating large-star and small-star steps over written tables.  Only texts of nodes
that have a bucket left are shingled again; a table written on the way is dropped once what it serves is written.

Repeated rows are copies of one another; null texts have no words; null ids count as documents without id;
an empty table gives no rows; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, map_batches, pieces, read_table, stage, staging
from .tokenization import plain_texts

WORDS, THRESHOLD = 5, 0.8
TARGET_RECALL = 1 - 3e-6  # of a pair at the threshold, on level 1
BRANCHES, LEVELS, POOL = 2, 4, 64
SHORT = 16  # sets of up to so many shingles have one branch more
BLOCK, DENSE, LOOSE = 2048, 0.5, 0.3
MEAN_SET = 4096  # shingles a node by which a block is filled
NO_ID = -(1 << 63)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def runs_for(target_recall: float, threshold: float) -> int:
    """Runs until a pair of this similarity shares a root with this probability: common roots are Poisson, ``threshold`` a run."""
    return math.ceil(-math.log(1 - target_recall) / threshold)


ROOTS = runs_for(TARGET_RECALL, THRESHOLD)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every text, one after another, and where each text's begin and end."""
    from pandas.util import hash_array

    split = pc.utf8_split_whitespace(plain_texts(column))
    coded = pc.dictionary_encode(split.flatten())
    vocabulary = coded.dictionary.to_numpy(zero_copy_only=False)
    codes = coded.indices.to_numpy(zero_copy_only=False)
    real = (vocabulary != "")[codes] if len(codes) else np.zeros(0, bool)
    hashes = hash_array(vocabulary, categorize=False)[codes[real]] if len(codes) else np.zeros(0, np.uint64)
    at = np.concatenate(([0], np.cumsum(real)))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    sizes = np.diff(at)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    places = np.arange(len(hashes))
    left = at[1:][owner] - places  # words from this one on
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes), np.uint64)
        for j in range(words):
            shifted = np.zeros(len(hashes), np.uint64)
            if j < len(hashes):
                shifted[: len(hashes) - j] = hashes[j:]
            power = _ODD[j % 5] * np.uint64(2 * (j // 5) + 1)
            total += np.where(left > j, _mix(shifted) * power, np.uint64(0))
        total = _mix(total + np.minimum(left, words).astype(np.uint64))
    begins = (left >= words) | ((sizes[owner] < words) & (places == at[:-1][owner]))
    values, owner = total[begins], owner[begins]
    bounds = np.searchsorted(owner, np.arange(len(sizes) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def _key(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def sketches(documents: DataFrame, words: int = WORDS, roots: int = ROOTS, pool: int = POOL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id (NO_ID for null), text_hash, key of the set, n, sampled roots, and the pool of sampled tokens (32-bit)."""
    names = ["doc_id", "text_hash", "key", "n", "roots", "pool"]

    def sampled(values, at, rate, seed):
        sizes = np.diff(at)
        hashes = _mix(values ^ np.uint64(seed))
        limit = np.minimum(2.0**64 * rate / np.maximum(sizes, 1), 2.0**64 - 2048).astype(np.uint64)
        chosen = hashes <= np.repeat(limit, sizes)
        return hashes[chosen], np.concatenate(([0], np.cumsum(chosen)))[at]

    def run(batches):
        for batch in pieces(batches, 4000):
            values, at = shingle_sets(batch.column(1), words)
            data = memoryview(values.tobytes())
            keys = [_key(data[a * 8 : b * 8]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            columns = [batch.column(0), batch.column(2), pa.array(keys, pa.binary()), pa.array(np.diff(at), pa.int64())]
            for rate, seed, kind in ((roots, 0x5851F42D4C957F2D, np.int64), (pool, 0x2545F4914F6CDD1D, np.int32)):
                hashes, offsets = sampled(values, at, rate, seed)
                # the sampled hashes are all small: mixed again, their bits are even
                columns.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array((_mix(hashes) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) if kind is np.int32 else _mix(hashes).view(np.int64))))
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    return map_batches(rows, run, "doc_id long, text_hash long, key binary, n long, roots array<long>, pool array<int>")


def _sized(rows: DataFrame) -> DataFrame:
    """Number of nodes of each path's bucket and a signature of its members."""
    own = [F.bit_xor(F.xxhash64(F.lit(i), F.col("key"))).alias(f"s{i}") for i in (1, 2)]
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("m"), *own).filter(F.col("m") > 1)


def buckets(nodes: DataFrame, root: str, block: int = BLOCK, dense: float = DENSE, branches: int = BRANCHES, levels: int = LEVELS) -> DataFrame:
    """Buckets to compare: path, key, m (nodes in the bucket).  ``nodes`` is a written table."""
    rows = stage(nodes.select("key", F.explode("roots").alias("path")), f"{root}/level1")
    found, sizes = [], []
    for d in range(1, levels + 1):
        own = stage(_sized(rows), f"{root}/sizes{d}")
        found.append(rows)
        sizes.append(own.filter(F.col("m") <= block))
        large = own.filter(F.col("m") > block).select("path", "m")
        if d == levels or large.isEmpty():
            sizes.append(own.filter(F.col("m") > block))
            break
        inside = stage(rows.join(large, "path"), f"{root}/inside{d}")  # written: its size is known to the next joins
        nodes = stage(nodes.join(inside.select("key"), "key", "left_semi").select("key", "n", "pool"), f"{root}/nodes{d}")
        inside = inside.join(nodes, "key")
        further = F.lit(branches) + F.when(F.col("n") <= SHORT, 1).otherwise(0)
        rate = further * F.lit(float(1 << 40)) / F.least(F.size("pool"), F.lit(POOL))
        chosen = F.filter("pool", lambda t: F.xxhash64(F.col("path"), t, F.lit(d)).bitwiseAND((1 << 40) - 1) < rate)
        children = inside.select("key", F.col("path").alias("parent"), "m", F.explode(chosen).alias("t"))
        children = stage(children.withColumn("path", F.xxhash64("parent", "t", F.lit(d))), f"{root}/level{d + 1}")
        each = children.groupBy("parent", "path").agg(F.count(F.lit(1)).cast("double").alias("c"), F.max("m").alias("m"))
        each = stage(each, f"{root}/counts{d}")
        density = each.groupBy("parent").agg((F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.max("m"))).alias("density"))
        whole = density.filter(F.col("density") >= dense).select(F.col("parent").alias("path"))
        sizes.append(own.filter(F.col("m") > block).join(whole, "path", "left_semi"))
        shared = each.filter("c > 1").join(density.filter(F.col("density") < dense), "parent").select("path")
        rows = children.join(shared, "path", "left_semi").select("key", "path")  # a path of one node leads nowhere
    every = sizes[0]
    for more in sizes[1:]:
        every = every.unionByName(more)
    # equal members: one bucket is enough
    kept = every.groupBy("m", "s1", "s2").agg(F.min("path").alias("path"))
    kept = stage(kept.select("path", "m"), f"{root}/kept")
    members = [rows.join(kept, "path").select("path", "key", "m") for rows in found]
    out = members[0]
    for more in members[1:]:
        out = out.unionByName(more)
    return out


def _blocks(key: bytes, m: int, block: int):
    """The pairs of blocks that a node belongs to: (first, second, own)."""
    parts = -(-m // block)
    mine = int.from_bytes(key[:8], "little") % parts
    return [(min(mine, other), max(mine, other), mine) for other in range(parts)]


def loose_buckets(members: DataFrame, nodes: DataFrame, loose: float = LOOSE, block: int = BLOCK) -> DataFrame:
    """path, key, m: buckets without the nodes that have no partner of estimated similarity ``loose``.

    A bucket in one block is replaced by its components; its new path is a hash of their members.
    """
    where = "path long, a int, b int, own int, m long, key binary, n long, pool binary"
    names = ["path", "a", "b", "own", "m", "key", "n", "pool"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]

    def spread(batches):
        for batch in pieces(batches, 4000):
            out = []
            for path, key, m, size, pool in zip(*(c.to_pylist() for c in batch.columns)):
                data = np.unique(np.array(pool, np.int32)).tobytes()
                out += [(path, a, b, own, m, key, size, data) for a, b, own in _blocks(key, m, block)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def finish(key, nodes):
        n = len(nodes)
        if n < 2:
            return []
        near = _perhaps_near([x[2] for x in nodes], np.array([x[3] for x in nodes], np.float64), loose)
        if key[1] != key[2]:
            own = np.array([x[0] for x in nodes])
            near &= own[:, None] != own[None, :]
        if key[3] > block:
            return [(key[0], nodes[i][1], key[3], nodes[i][3]) for i in np.flatnonzero(near.any(1)).tolist()]
        out, label = [], _labels(near)
        for first in np.flatnonzero(np.bincount(label, minlength=n) > 1).tolist():
            own = sorted((nodes[i][1], nodes[i][3]) for i in np.flatnonzero(label == first).tolist())
            path = int.from_bytes(hashlib.blake2b(b"".join(k for k, _ in own), digest_size=8).digest(), "little", signed=True)
            out += [(path, k, len(own), size) for k, size in own]
        return out

    def run(batches):
        names, types = ["path", "key", "m", "n"], [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
        current, nodes, out = None, [], []
        for batch in pieces(batches, 4000):
            for path, a, b, own, m, key, size, pool in zip(*(c.to_pylist() for c in batch.columns)):
                if current != (path, a, b, m):
                    if current:
                        out += finish(current, nodes)
                    current, nodes = (path, a, b, m), []
                nodes.append((own, key, np.frombuffer(pool, np.int32), size))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if current and (out := finish(current, nodes)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    pooled = map_batches(members.join(nodes.select("key", "n", "pool"), "key").select("path", "key", "m", "n", "pool"), spread, where)
    dealt = pooled.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "key")
    return map_batches(dealt, run, "path long, key binary, m long, n long").distinct()


def largest_buckets(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """path, key, parts: the buckets but for those whose nodes all have the same larger bucket, and into how many blocks each is cut."""
    most = members.groupBy("key").agg(F.max(F.struct("m", "path")).alias("most"))
    judged = members.join(most, "key").groupBy("path").agg(F.min("most").alias("least"), F.max("most").alias("most"), F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("shingles"))
    inside = (F.col("least") == F.col("most")) & (F.col("most.path") != F.col("path"))
    parts = F.ceil(F.greatest(F.col("nodes") / block, F.col("shingles") / (block * MEAN_SET))).cast("int")
    return members.join(judged.filter(~inside).select("path", parts.alias("parts")), "path").select("path", "key", "parts")


def _sets(texts: DataFrame, words: int) -> DataFrame:
    """key and shingles (32-bit, sorted) of each text."""

    def run(batches):
        for batch in pieces(batches, 500):
            values, at = shingle_sets(batch.column(0), words)
            data = memoryview(values.tobytes())
            keys, sets = [], []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                keys.append(_key(data[a * 8 : b * 8]))
                sets.append(np.unique(values[a:b].astype(np.uint32)).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sets, pa.binary())], ["key", "shingles"])

    return map_batches(texts.select("text"), run, "key binary, shingles binary")


def _spread(sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, a, b, own, key, copies, shingles, paths: each node's set to each of its buckets, to each pair of blocks of a large one."""
    sent = sets.join(wanted, "key").select("key", "copies", "shingles", F.transform("paths", lambda p: p["path"]).alias("paths"), F.explode("paths").alias("p"))
    own = F.pmod(F.xxhash64("key"), F.col("p.parts")).cast("int")
    sent = sent.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("p.parts") - 1)).alias("other"))
    return sent.select(F.col("p.path").alias("path"), F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", "key", "copies", "shingles", "paths")


def _common(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocks of columns."""
    values, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    place = np.cumsum(shared) - 1
    use = shared[inverse]
    rows, cols = rows[use], place[inverse[use]]
    total = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    for at in range(0, int(shared.sum()), columns):
        a, b = np.searchsorted(cols, (at, at + columns))
        part = np.zeros((len(sets), columns), np.float32)
        part[rows[a:b], cols[a:b] - at] = 1
        total += part @ part.T
    return total


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of pairs of different sorted sets."""
    if len(sets) == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(*sets, assume_unique=True))
        return common
    return _common(sets).astype(np.float64)  # whole numbers: exact in either width


def _perhaps_near(pools: list[np.ndarray], sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets of these sizes have this similarity by the estimate from their sorted pools."""
    common, held = _shared(pools), np.array([len(x) for x in pools], np.float64)
    first, second = sizes[:, None], sizes[None, :]
    larger = np.where(first > second, held[:, None], np.where(first < second, held[None, :], np.minimum(held[:, None], held[None, :])))
    share = threshold / (1 + threshold) * (1 + np.minimum(first, second) / np.maximum(first, second))  # of the larger set
    near = common >= share * larger - 1e-6
    np.fill_diagonal(near, False)
    return near


def _near(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sorted sets have this similarity."""
    common = _shared(sets)
    sizes = np.array([len(x) for x in sets], np.float64)
    near = common * (1 + threshold) >= threshold * (sizes[:, None] + sizes[None, :]) - 1e-6
    np.fill_diagonal(near, False)
    return near


def _labels(near: np.ndarray) -> np.ndarray:
    """For each node the first node of its component."""
    label = np.arange(len(near))
    while True:  # least label of the neighbours, until nothing changes
        least = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def compare(path: int, nodes: list[tuple], threshold: float, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Links of each node (copies of its partners) counted at this path, and for each node the first node it is connected with.

    ``nodes``: own block, key, copies, set, paths; ``across``: only pairs of different blocks.
    """
    n = len(nodes)
    near = _near([x[3] for x in nodes], threshold)
    if across:
        own = np.array([x[0] for x in nodes])
        near &= own[:, None] != own[None, :]
    if not near.any():
        return np.zeros(n, np.int64), np.arange(n)
    lesser = [x[4][x[4] < path] for x in nodes]
    counted = near & (_common(lesser) == 0)
    return counted @ np.array([x[2] for x in nodes], np.int64), _labels(near)


def compare_buckets(sent: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """key, links, other: a count a node and bucket, and an edge to a node of its component there."""
    names, types = ["key", "links", "other"], [pa.binary(), pa.int64(), pa.binary()]

    def finish(where, nodes):
        if len(nodes) < 2:
            return []
        links, label = compare(where[0], nodes, threshold, where[1] != where[2])
        return [(nodes[i][1], int(links[i]), nodes[label[i]][1]) for i in np.flatnonzero((links > 0) | (label != np.arange(len(nodes)))).tolist()]

    def run(batches):
        where, nodes, out, last = None, [], [], None
        for batch in pieces(batches, 1000):
            for path, a, b, own, key, copies, shingles, paths in zip(*(c.to_pylist() for c in batch.columns)):
                if where != (path, a, b):
                    out += finish(where, nodes)
                    where, nodes, last = (path, a, b), [], None
                if key != last:  # sorted by key: repeated rows are next to each other
                    nodes.append((own, key, copies, np.frombuffer(shingles, np.uint32), np.array(paths, np.int64)))
                    last = key
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                out = []
        if out := finish(where, nodes):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    dealt = sent.repartition("path", "a", "b").sortWithinPartitions("path", "a", "b", "key")
    return map_batches(dealt, run, "key binary, links long, other binary")


def components(edges: DataFrame, root: str, rounds: int = 50) -> DataFrame:
    """node, leader (the least node of its component) for every node of ``edges`` (x, y)."""
    edges = stage(edges.filter(F.col("x") != F.col("y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct(), f"{root}/edges")
    before, spark, old = None, edges.sparkSession, f"{root}/edges"
    for r in range(rounds):
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("low")).select("x", F.least("x", "low").alias("low"))
        star = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("x"), F.col("low").alias("y")).filter(F.col("x") != F.col("y")).distinct()
        star = stage(star, f"{root}/large-star{r}")
        low = star.groupBy("x").agg(F.min("y").alias("low"))
        moved = star.join(low, "x").filter(F.col("y") != F.col("low")).select(F.col("y").alias("x"), F.col("low").alias("y"))
        edges = stage(moved.unionByName(low.select("x", F.col("low").alias("y"))).filter(F.col("x") != F.col("y")).distinct(), f"{root}/small-star{r}")
        drop_path(spark, old)
        drop_path(spark, f"{root}/large-star{r}")
        old = f"{root}/small-star{r}"
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("x").alias("node"), F.col("y").alias("leader"))


def jaccard_links(documents: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", target_recall: float = TARGET_RECALL, branches: int = BRANCHES, levels: int = LEVELS, block: int = BLOCK, dense: float = DENSE, identify: bool = False) -> DataFrame:
    """doc_id, class_id, links of every row; if asked, the text's hash (xxhash64) and a name of its component that no other has."""
    spark: SparkSession = documents.sparkSession
    root = staging(spark, "jaccard")
    rows = stage(sketches(documents, words, runs_for(target_recall, threshold), id_col=id_col, text_col=text_col), f"{root}/rows")
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    nodes = rows.filter("n > 0").groupBy("key").agg(first, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("roots").alias("roots"), F.first("pool").alias("pool"))
    nodes = stage(nodes.select("key", "first.*", "copies", "n", "roots", "pool"), f"{root}/nodes")
    loose = stage(loose_buckets(buckets(nodes, f"{root}/buckets", block, dense, branches, levels), nodes, threshold * LOOSE / THRESHOLD, block), f"{root}/loose")
    drop_path(spark, f"{root}/buckets")
    members = stage(largest_buckets(loose, block), f"{root}/members")
    wanted = members.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("path", "parts"))).alias("paths"))
    wanted = stage(wanted.join(nodes.select("key", "doc_id", "text_hash", "copies"), "key"), f"{root}/wanted")
    texts = documents.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(text_col).alias("text_hash"))
    texts = texts.join(wanted.select("doc_id", "text_hash"), ["doc_id", "text_hash"], "left_semi")
    sets = _sets(texts, words).groupBy("key").agg(F.first("shingles").alias("shingles"))  # repeated rows meet before the shuffle
    found = stage(compare_buckets(_spread(sets, wanted.select("key", "copies", "paths")), threshold), f"{root}/found")
    for name in ("loose", "members", "wanted"):
        drop_path(spark, f"{root}/{name}")
    leaders = components(found.select(F.col("key").alias("x"), F.col("other").alias("y")), f"{root}/components")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    named = nodes.select("key", "doc_id", "copies").join(links, "key", "left").join(leaders.withColumnRenamed("node", "key"), "key", "left")
    named = stage(named.select("key", "doc_id", "leader", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")), f"{root}/named")
    for name in ("nodes", "found", "components"):
        drop_path(spark, f"{root}/{name}")
    least = named.groupBy(F.coalesce("leader", "key").alias("leader")).agg(F.min("doc_id").alias("class_id"))
    named = named.withColumn("leader", F.coalesce("leader", "key")).join(least, "leader").select("key", "class_id", "links", "leader")
    out = rows.select("doc_id", "text_hash", "key", "n").join(named, "key", "left")
    some = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(some("doc_id").alias("doc_id"), F.when(F.col("n") > 0, some("class_id")).otherwise(some("doc_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"), *["text_hash", F.col("leader").alias("component")] * identify)


def one_of_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows without links, and of each component the row of least id (then least hash of the text), once."""
    links = jaccard_links(documents, id_col=id_col, text_col=text_col, identify=True, **options).filter("links > 0")
    grouped = links.select(F.struct("doc_id", "text_hash").alias("similar_row"), "component").distinct()
    first = grouped.groupBy("component").agg(F.min("similar_row").alias("first"))
    marks = grouped.join(first, "component").select(F.col("similar_row.doc_id").alias("similar_id"), F.col("similar_row.text_hash").alias("similar_hash"), (F.col("similar_row") == F.col("first")).alias("similar_first"))
    own = F.xxhash64(text_col)
    tagged = documents.join(marks, F.col(id_col).cast("long").eqNullSafe(F.col("similar_id")) & (own == F.col("similar_hash")), "left")
    single = tagged.filter(F.col("similar_first").isNull()).select(*documents.columns)
    survivors = tagged.filter("similar_first").dropDuplicates(["similar_id", "similar_hash"]).select(*documents.columns)
    return single.unionByName(survivors)


def query(spark, sf_dir):
    return jaccard_links(read_table(spark, sf_dir, "documents"))
