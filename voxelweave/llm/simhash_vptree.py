"""SimHash near-duplicates by vantage-point trees.

A fingerprint is a 64-bit majority vote over the XXH64 values of 4-word shingles. Two fingerprints link at ``max_bits`` or
fewer differing bits. The exact search runs in the Hamming metric of three bit blocks: two fingerprints at 4 bits or fewer have
a block where they differ in at most 4 // 3 = 1 bit. Per block a vantage-point tree partitions the fingerprints: inside or
outside a ball around a vantage point. Every fingerprint has one home leaf; by the triangle inequality a fingerprint inside a
ball need only be looked for outside if it lies within the tolerance of the surface, so boundary rows are sent as queries to
the shards beyond, and all other branches are pruned. Leaves compare the full 64 bits.

Blocks keep the tolerance small against the spread of distances: over all 64 bits it is 4 against a standard deviation of 4 and
almost two thirds of all rows would cross every boundary; over 21 bits it is 1 against 2.3, about a third.

Trees are fitted on a bounded sample of distinct fingerprints; a sample changes the balance of shards, never the result.
Shards with more rows than ``shard_rows`` are cut into chunks and compared chunk pair by chunk pair. A task sends star edges to
the smallest node of a component it found, so a group of n copies gives O(n) edges, not O(n^2).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from voxelweave.llm.common import sized, stored
from voxelweave.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
HASHED_AT_ONCE = 1 << 16


def fingerprint(text: str | None, width: int = 4, seed: int = 42) -> int:
    """Majority bits of the shingles' XXH64; 0 without words. Null counts as empty."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split: 0x20 and 0x09 to 0x0D
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - width + 1].tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), HASHED_AT_ONCE):
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at : at + HASHED_AT_ONCE], ends[at : at + HASHED_AT_ONCE])], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(documents: DataFrame, width: int = 4, seed: int = 42) -> DataFrame:
    """Rows (doc_id, bits long: the fingerprint as a signed 64-bit number), one for each row of ``documents``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.fromiter((fingerprint(t.as_py(), width, seed) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, bits long")


# ------------------------------------------------------------------ trees

def bit_blocks(blocks: int) -> list[np.uint64]:
    """Masks of ``blocks`` runs of bits, as even as 64 allows."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [np.uint64(((1 << (b - a)) - 1) << a) for a, b in zip(edges, edges[1:])]


def grow_tree(points: np.ndarray, tolerance: int, leaf_rows: int, seed: int = 42, tries: int = 6) -> dict[str, np.ndarray]:
    """Vantage-point tree over a sample: arrays pivot, radius, inside, outside. Children below 0 are leaves (-1 - leaf)."""
    rng = np.random.default_rng(seed)
    nodes: list[list] = []
    leaves = 0
    root, todo = -1, [(points, None, None)]
    while todo:
        own, parent, side = todo.pop()
        best = None
        if len(own) > leaf_rows:
            for vantage in rng.choice(own, tries):
                spread = np.bincount(np.bitwise_count(own ^ vantage), minlength=65)
                inside = np.cumsum(spread)
                crossing = sum(np.concatenate([spread[k:], np.zeros(k, spread.dtype)]) for k in range(1 - tolerance, tolerance + 1) if k >= 0) if tolerance else 0 * spread
                cost = np.maximum(inside, len(own) - inside) + crossing
                cost[(inside == 0) | (inside == len(own))] = 1 << 60
                radius = int(np.argmin(cost))
                if cost[radius] < 1 << 60 and (best is None or cost[radius] < best[0]):
                    best = (cost[radius], vantage, radius)
        if best is None:
            child, leaves = -1 - leaves, leaves + 1
        else:
            child = len(nodes)
            nodes.append([best[1], best[2], 0, 0])
            near = np.bitwise_count(own ^ best[1]) <= best[2]
            todo += [(own[near], child, 2), (own[~near], child, 3)]
        if parent is None:
            root = child
        else:
            nodes[parent][side] = child
    return {
        "root": root, "leaves": leaves, "pivot": np.array([n[0] for n in nodes], np.uint64), "radius": np.array([n[1] for n in nodes], np.int16),
        "inside": np.array([n[2] for n in nodes], np.int32), "outside": np.array([n[3] for n in nodes], np.int32),
    }


def descend(tree: dict, points: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every shard in which a point lives or has to be looked for.

    A row that is still on its home path sends a query outwards only: of two near points on either side of a surface the inner
    one lies within the tolerance of it. Queries follow every branch that the triangle bounds leave.
    """
    row, node = np.arange(len(points)), np.full(len(points), tree["root"], np.int32)
    home, rows, leaves = np.ones(len(points), bool), [], []
    while len(row):
        done = node < 0
        rows.append(row[done])
        leaves.append(-1 - node[done])
        row, node, home = row[~done], node[~done], home[~done]
        if not len(row):
            break
        distance = np.bitwise_count(points[row] ^ tree["pivot"][node]).astype(np.int16)
        radius = tree["radius"][node]
        lives_in = distance <= radius
        goes_in = np.where(home, lives_in, distance - tolerance <= radius)
        goes_out = distance + tolerance > radius
        row, node, home = (
            np.concatenate([row[goes_in], row[goes_out]]),
            np.concatenate([tree["inside"][node[goes_in]], tree["outside"][node[goes_out]]]),
            np.concatenate([home[goes_in], (home & ~lives_in)[goes_out]]),
        )
    return np.concatenate(rows), np.concatenate(leaves)


def local_links(node: np.ndarray, max_bits: int, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Star edges (fingerprint, smallest fingerprint) of the components among the given ones, as signed numbers.

    Rows leave the list once their component is complete, so copies near each other cost one pass, not one pass each.
    """
    node = np.unique(node)
    bits = node.view(np.uint64)
    left, alive, child, parent = np.arange(len(bits)), np.ones(len(bits), bool), [], []
    while len(left):
        seeds = left[:block]
        near = np.bitwise_count(bits[seeds][:, None] ^ bits[left][None, :]) <= max_bits
        partners = seeds[near.sum(axis=1) > 1]
        lonely = seeds[near.sum(axis=1) <= 1]
        alive[lonely] = False
        left = left[alive[left]]
        for seed in partners:
            if not alive[seed]:
                continue
            alive[seed] = False
            left = left[left != seed]
            frontier = np.array([seed])
            while len(frontier) and len(left):
                found = (np.bitwise_count(bits[frontier[:block]][:, None] ^ bits[left][None, :]) <= max_bits).any(axis=0)
                new, left = left[found], left[~found]
                alive[new] = False
                child.append(node[new])
                parent.append(np.full(len(new), node[seed]))
                frontier = np.concatenate([frontier[block:], new])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *child]), np.concatenate([none, *parent])


def links(distinct: DataFrame, max_bits: int = 4, blocks: int = 3, sample_rows: int = 131_072, leaf_rows: int = 1_024, shard_rows: int = 8_192) -> DataFrame:
    """Star edges (u, v) whose closure equals that of all pairs at ``max_bits`` or fewer bits.

    ``distinct``: stored table with a column ``bits`` of distinct fingerprints, which are the nodes. ``sample_rows`` bounds what is fitted on the driver,
    ``leaf_rows`` is the aim for a shard's size and ``shard_rows`` the bound of a chunk.
    """
    total = distinct.count()
    sample = distinct.select("bits").orderBy(F.xxhash64("bits"), "bits").limit(sample_rows).toPandas()["bits"].to_numpy(np.int64).view(np.uint64)
    aim = max(8, int(leaf_rows * len(sample) / max(1, total)))
    tolerance, masks = max_bits // blocks, bit_blocks(blocks)
    shared = distinct.sparkSession.sparkContext.broadcast([grow_tree(sample & mask, tolerance, aim) for mask in masks])

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bits = batch["bits"].to_numpy(np.int64)
            for block, (tree, mask) in enumerate(zip(shared.value, masks)):
                for at in range(0, len(bits), 4096):
                    row, leaf = descend(tree, bits[at : at + 4096].view(np.uint64) & mask, tolerance)
                    yield pd.DataFrame({"shard": leaf.astype(np.int32) * blocks + block, "bits": bits[at + row]})

    routed = stored(distinct.select("bits").mapInPandas(route, "shard int, bits long"), "routed")
    sizes = stored(routed.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(shard_rows)).cast("int").alias("chunks")), "sizes")
    own = F.pmod(F.xxhash64("bits"), F.col("chunks")).cast("int")
    tasks = (
        routed.join(sized(sizes), "shard").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("shard", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "bits")
    )

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        u, v = local_links(pdf["bits"].to_numpy(np.int64), max_bits)
        return pd.DataFrame({"u": u, "v": v})

    return tasks.groupBy("shard", "low", "high").applyInPandas(compare, "u long, v long")


def near_duplicates(documents: DataFrame, max_bits: int = 4, width: int = 4, seed: int = 42, **search: int) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), one for each row of ``documents``.

    Only ``doc_id`` and ``text`` are read, so other columns may have any name. Null text counts as empty; texts without words
    share fingerprint zero. Repeated rows come back repeated. A null doc_id keeps its row and is never the smallest id of a
    component; a component of null ids alone has component_id null. An empty table gives no rows. ``search``: see ``links``.
    """
    prints = stored(fingerprints(documents, width, seed), "fingerprints")
    distinct = stored(prints.groupBy("bits").agg(F.min("doc_id").alias("least")), "distinct")
    found = connected_components(links(distinct, max_bits, **search)).withColumnRenamed("node", "bits")
    named = distinct.join(found, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = stored(named.join(least, "component").select("bits", "component_id"), "by_print")
    return prints.join(by_print, "bits").select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id",
    )


def one_per_group(documents: DataFrame, **how: int) -> DataFrame:
    """``documents`` without the rows of a component that do not have its smallest doc_id; columns and texts stay.

    Of repeated rows with that same id one stays. Rows without an id cannot be told apart and stay.
    """
    found = stored(near_duplicates(documents, **how), "near_duplicates")
    drop = stored(found.where("doc_id <> component_id").select("doc_id").distinct(), "drop")
    kept = documents.join(sized(drop), "doc_id", "left_anti").select(*documents.columns)
    again = stored(found.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again")
    if again.isEmpty():
        return kept
    repeated = kept.join(sized(again), "doc_id", "left_semi").select(*documents.columns)
    return kept.join(sized(again), "doc_id", "left_anti").select(*documents.columns).unionByName(repeated.dropDuplicates(["doc_id"]))
