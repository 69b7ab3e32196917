"""Near-duplicates by SimHash fingerprints, joined along a binary trie."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.frames import checkpointed, found_again, local_roots, row_key, runs

#: Shingles whose bits are counted together.
COUNTED_TOGETHER = 1 << 17
#: Fingerprints below a node of the level at which pairs of subtrees become tasks, on average.
SUBTREE = 1 << 13
#: Pairs of fingerprints that a pair of nodes may hold to be compared at once, and node pairs that
#: are split at a time.
LEAF, FRONTIER = 64, 1 << 17


def shingle_hashes(text: str, width: int, seed: int) -> np.ndarray:
    """XXH64 of every ``width``-word shingle of the lower-cased text, repeats included.

    Words are runs of anything but ASCII white space, A-Z become lower case, a shingle's words are
    joined by one space. Fewer words give one shingle of them all, none give no shingle.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    line = b" ".join(words)
    hashed = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([hashed(line, seed)], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-width] + 1)).tolist()
    spans = zip(starts, ends[width - 1 :].tolist(), strict=True)
    return np.fromiter((hashed(line[a:b], seed) for a, b in spans), np.uint64, len(starts))


def _bit_counts(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Set bits at each of the 64 places, from each start to the next."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return np.add.reduceat(bits, starts, axis=0, dtype=np.int32)


def fingerprints_of(texts: list[str], width: int = 3, seed: int = 42) -> np.ndarray:
    """A signed 64-bit fingerprint for each text: a bit is set if over half its hashes set it."""
    found = np.zeros(len(texts), dtype=np.int64)
    waiting: list[np.ndarray] = []
    whose: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if whose:
            sizes = np.array([len(h) for h in waiting])
            counts = _bit_counts(np.concatenate(waiting), np.cumsum(sizes) - sizes)
            found[whose] = _packed(counts, sizes)
        waiting.clear()
        whose.clear()
        held = 0

    for row, text in enumerate(texts):
        hashes = shingle_hashes(text, width, seed)
        if len(hashes) > COUNTED_TOGETHER:
            parts = [hashes[k : k + COUNTED_TOGETHER] for k in range(0, len(hashes), COUNTED_TOGETHER)]
            counts = sum(_bit_counts(p, np.array([0])).astype(np.int64) for p in parts)
            found[row] = _packed(counts, np.array([len(hashes)]))[0]
        elif len(hashes):
            waiting.append(hashes)
            whose.append(row)
            held += len(hashes)
            if held > COUNTED_TOGETHER:
                flush()
    flush()
    return found


def _packed(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    return np.packbits(2 * counts > sizes[:, None], axis=1).view(np.int64).ravel()


def fingerprints(docs: DataFrame, columns: list[str], text: str, width: int = 3, seed: int = 42) -> DataFrame:
    """``columns`` of every row with its ``fp``; null and empty texts have fingerprint zero.

    Bits are counted in blocks of shingles, so a very long text takes no more memory than its hashes.
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(0).to_pylist()]
                found = pa.array(fingerprints_of(texts, width, seed))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], found], names=[*part.schema.names[1:], "fp"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(F.col(text).alias("_text"), *columns).mapInArrow(hashed, f"{kinds}, fp long")


def close_pairs(
    left: np.ndarray, right: np.ndarray, same: bool, level: int, budget: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in ``left``, in ``right``) of fingerprints that differ in ``budget`` bits or fewer.

    Both are sorted, distinct, and share their first ``level`` bits among themselves: they are the
    fingerprints below two nodes of a binary trie. Pairs of nodes go down together; bits that differ
    add up, and a pair over the budget is dropped with all below it. ``same`` joins a node with
    itself, each pair once. Pairs of small nodes are compared at once; the work list is split depth
    first, so memory does not grow with the number of pairs.
    """
    apart = 0 if same else _head_distance(left, right, level)
    if not len(left) or not len(right) or apart > budget:
        return
    one = np.array([0]), np.array([len(left)]), np.array([0]), np.array([len(right)]), np.array([apart]), np.array([same])
    stack = [(level, one)]
    while stack:
        level, nodes = stack.pop()
        if len(nodes[0]) > FRONTIER:
            stack.append((level, tuple(x[FRONTIER:] for x in nodes)))
            nodes = tuple(x[:FRONTIER] for x in nodes)
        size = (nodes[1] - nodes[0]) * (nodes[3] - nodes[2])
        small = (size <= LEAF) | (level == 64)
        if small.any():
            a_low, _, b_low, b_high, _, own = (x[small] for x in nodes)
            n = size[small]
            which = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            wide = (b_high - b_low)[which]
            i, j = a_low[which] + k // wide, b_low[which] + k % wide
            near = (np.bitwise_count(left[i] ^ right[j]) <= budget) & (~own[which] | (i < j))
            if near.any():
                yield i[near], j[near]
            nodes = tuple(x[~small] for x in nodes)
        if not len(nodes[0]):
            continue
        a_low, a_high, b_low, b_high, d, own = nodes
        a_mid, b_mid = _middle(left, a_low, level), _middle(right, b_low, level)
        children = [
            (a_low, a_mid, b_low, b_mid, d, own),
            (a_mid, a_high, b_mid, b_high, d, own),
            (a_low, a_mid, b_mid, b_high, d + 1, np.zeros_like(own)),
            tuple(x[~own] for x in (a_mid, a_high, b_low, b_mid, d + 1, own)),
        ]
        below = tuple(np.concatenate(x) for x in zip(*children, strict=True))
        alive = (below[0] < below[1]) & (below[2] < below[3]) & (below[4] <= budget)
        stack.append((level + 1, tuple(x[alive] for x in below)))


def _head_distance(left: np.ndarray, right: np.ndarray, level: int) -> int:
    if not level or not len(left) or not len(right):
        return 0
    return int(np.bitwise_count((left[0] ^ right[0]) >> np.uint64(64 - level)))


def _middle(values: np.ndarray, low: np.ndarray, level: int) -> np.ndarray:
    """Where the branch with the next bit set begins, for nodes of ``level`` that begin at ``low``."""
    tail = (1 << (64 - level)) - 1
    bit = np.uint64(1 << (63 - level))
    return np.searchsorted(values, (values[low] & np.uint64(~tail & 0xFFFFFFFFFFFFFFFF)) | bit)


def trie_links(prints: DataFrame, fp: str, max_bits: int = 2) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within ``max_bits`` into their groups.

    The trie's upper levels decide which subtrees can hold close fingerprints: two nodes of one level
    whose paths differ in too many bits are dropped with all below them. Each pair of nodes left is a
    task's unit, holding the fingerprints of its two subtrees, about ``SUBTREE`` each: the level
    follows from the number of fingerprints. Inside, `close_pairs` finds every close pair; the links
    returned are a forest of them with the same groups, so that a group never emits all its pairs.
    """
    distinct = checkpointed(prints.select(F.col(fp).alias("fp")).dropna().distinct())
    level = min(24, max(0, math.ceil(math.log2(max(1, distinct.count()) / SUBTREE))))
    flips = [sum(1 << b for b in bits) for n in range(min(level, max_bits) + 1) for bits in combinations(range(level), n)]
    if level:
        node = F.shiftrightunsigned("fp", 64 - level)
    else:
        node = F.lit(0).cast("long")
    paired = (
        distinct.withColumn("node", node)
        .withColumn("flip", F.explode(F.array(*[F.lit(m).cast("long") for m in flips])))
        .withColumn("other", F.col("node").bitwiseXOR(F.col("flip")))
        .select(
            (F.least("node", "other") * (1 << level) + F.greatest("node", "other")).alias("pair"),
            (F.col("node") > F.col("other")).cast("int").alias("side"),
            "fp",
        )
    )

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (pair,), rows in runs(batches, ["pair"]):
            fps = rows.column("fp").to_numpy().view(np.uint64)
            side = rows.column("side").to_numpy()
            same = pair >> level == pair & ((1 << level) - 1)
            left = np.sort(fps[side == 0])
            right = left if same else np.sort(fps[side == 1])
            offset = 0 if same else len(left)
            both = left if same else np.concatenate((left, right))
            root = np.arange(len(both))
            for i, j in close_pairs(left, right, same, level, max_bits):
                j = j + offset
                root = local_roots(len(both), np.concatenate((np.arange(len(both)), i)), np.concatenate((root, j)))
            linked = np.flatnonzero(root != np.arange(len(both)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(both[linked].view(np.int64)), pa.array(both[root[linked]].view(np.int64))], names=["a", "b"]
            )

    tasks = max(1, min(len(flips) << level, 1 << 16))
    parts = max(tasks // 4, int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return paired.repartition(parts, "pair").sortWithinPartitions("pair").mapInArrow(joined, "a long, b long")


def near_duplicates(prints: DataFrame, doc_id: str, fp: str, max_bits: int = 2) -> DataFrame:
    """``prints`` with ``component`` and its ``component_id``, the smallest id reachable by links.

    Equal fingerprints are one node, however many rows have them, so copies meet only in combined
    minima. Rows with a null fingerprint get a null component; a null id is never the smallest while
    its component has another. No rows give none.
    """
    nodes = components(checkpointed(trie_links(prints, fp, max_bits)), "a", "b")
    least = prints.groupBy(F.col(fp).alias("node")).agg(F.min(doc_id).alias("least"))
    labelled = least.join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = labelled.join(ids, "component").select(F.col("node").alias("_node"), "component", "component_id")
    return prints.join(by_print, prints[fp].eqNullSafe(by_print["_node"]), "left").drop("_node")


def representatives(docs: DataFrame, doc_id: str, text: str, width: int = 3, seed: int = 42, max_bits: int = 2) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: one with the group's smallest id.

    All columns stay as they are. Of several rows with that id, the one whose text hashes lowest
    stays, and one of equal rows.
    """
    keyed = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"), row_key(F.col(text)).alias("_key"))
    prints = checkpointed(fingerprints(keyed, ["_id", "_key"], "_text", width, seed))
    found = near_duplicates(prints, "_id", "fp", max_bits)
    best = (
        found.where(F.col("_id").eqNullSafe(F.col("component_id")))
        .groupBy("component", "_id", "_key")
        .agg(F.count("*").alias("_rows"))
        .groupBy("component")
        .agg(F.min(F.struct("_id", "_key", "_rows")).alias("_best"))
        .select("_best.*")
    )
    return found_again(docs, {"_id": F.col(doc_id), "_key": row_key(F.col(text))}, best, [])[0]
