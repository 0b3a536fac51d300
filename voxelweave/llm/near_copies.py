"""Near copies by the Jaccard similarity of word shingles.

Two texts link if the sets of their ``WIDTH``-word shingles have a Jaccard similarity of ``SHARE`` or more; of each component
one row stays. Texts with equal sets are one node.

Most candidates come from the vantage-point trees over SimHash fingerprints (``simhash_vptree``): each node of a component of near
fingerprints is compared with its smallest node, and whole sets decide. Fingerprints miss near copies, so a prefix filter finds the
rest, of which none is missed: in any one order of all shingles, sets of that similarity share one
of their first n - ceil(0.8 n) + 1. The order puts rare shingles first, by classes of their counts in a sample (a table of bounded
size; a wrong class costs time only). So texts that share a passage do not meet unless it makes up almost all of them. Sizes
and positions bound the similarity of a candidate, then sketches of about a bit for each shingle do (``parity``), so that sets are made
for few pairs beside the alike ones; whole sets decide.

Crowded buckets are first compared in stars: each node with one hub that it shares most buckets with. Buckets whose nodes are of one
component are closed. What is left is compared pair by pair, across components only. So a group of m near copies costs O(m)
comparisons. Sets are made from the texts where they are compared; no table of sets is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from voxelweave.llm.common import Scratch, sized, stored
from voxelweave.llm.components import connected_components
from voxelweave.llm.simhash_vptree import LOWER, fingerprints, links as near_fingerprints
from voxelweave.llm.toxicity import slices

WIDTH = 5
SHARE = (4, 5)  # 0.8 as a fraction, so that the comparison is in whole numbers
SAMPLE = 32
SLOTS = 1 << 22
STARS = 6
MOST_BITS = 1 << 29
ENTRY = "array<struct<bucket:long,at:int>>"


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct XXH64 values of the runs of ``width`` words (of all words if fewer); none without words."""
    words = (text or "").encode().translate(LOWER).split()  # bytes.split: 0x20 and 0x09 to 0x0D
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)
    width = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    found = (digest(joined[a:b], 42) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist()))
    return np.unique(np.fromiter(found, np.uint64, len(words) - width + 1))


def parity(found: np.ndarray) -> bytes:
    """Bits that tell which slots hold an odd number of shingles; as many slots as shingles, up to the next power of two (64 at least)."""
    size = 1 << max(6, (len(found) - 1).bit_length())
    return np.packbits(np.bincount((found & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1, bitorder="little").tobytes()


def may_be_alike(one: bytes, two: bytes, n: int, m: int) -> bool:
    """Whether sets of n and m shingles with these parities may have the similarity: they differ in a shingle at least for each bit that differs."""
    over, under = SHARE
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(two, np.uint8)), key=len)
    differing = int(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum())
    return (over + under) * (n + m - differing) >= 2 * over * (n + m)


def least_shared(n, m, at_n=0, at_m=0):
    """Whether sets of n and m elements whose first common elements stand at these positions may have the similarity."""
    over, under = SHARE
    return (over + under) * (n - at_n) >= over * (n + m), (over + under) * (m - at_m) >= over * (n + m)


def _node(found: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(found.tobytes(), 42)], np.uint64).view(np.int64)[0])


def rarity(documents: DataFrame, share: int = SAMPLE) -> np.ndarray:
    """For each slot of shingle hashes the class (binary logarithm) of the largest count in a sample; 0 for what is found once at most."""
    sample = documents.select("doc_id", "text").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(share)) == 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            sets = [shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    level = F.least(F.lit(15), F.floor(F.log2("n"))).cast("int")
    slots = counts.groupBy(F.col("h").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).agg(F.max(level).alias("level")).toArrow()
    classes = np.zeros(SLOTS, np.uint8)
    classes[slots.column("slot").to_numpy()] = slots.column("level").to_numpy()
    return classes


def prefix(found: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first elements of the set in the order of the filter."""
    over, under = SHARE
    n = len(found)
    keep = n - -(-over * n // under) + 1 if n else 0
    order = np.lexsort((found, classes[(found & np.uint64(SLOTS - 1)).astype(np.int64)]))
    return found[order[:keep]]


def prints(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, node, n: size of the set, prefix, parity), one for each row of ``documents``. Null counts as empty."""
    shared = documents.sparkSession.sparkContext.broadcast(rarity(documents))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            nodes, sizes, firsts, sketches = [], [], [], []
            for text in batch.column(2):  # one set at a time, as workers stay for the later stages
                found = shingles(text.as_py())
                nodes.append(_node(found))
                sizes.append(len(found))
                firsts.append(prefix(found, shared.value).view(np.int64))
                sketches.append(parity(found))
            made = [pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["doc_id", "text_key", "node", "n", "prefix", "parity"])

    keyed = documents.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    return keyed.mapInArrow(run, "doc_id long, text_key long, node long, n long, prefix array<long>, parity binary")


def crowded_bits(found: DataFrame) -> np.ndarray:
    """A table of bits by shingle hash that has every bucket with two rows or more, and few others while there are fewer of them than
    bits. Only hashes are shuffled; what reaches the driver is bounded by ``MOST_BITS``."""
    each = found.where("n > 0").select(F.explode("prefix").alias("bucket"))
    size = min(MOST_BITS, 1 << max(16, (2 * (each.count() or 1)).bit_length()))
    counts = each.repartition("bucket").groupBy("bucket").agg(F.count("*").alias("rows")).where("rows > 1")
    slot = F.col("bucket").bitwiseAND(F.lit(size - 1))
    words = counts.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bucket & 63 as int))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.uint64)
    bits[words.column("at").to_numpy()] = words.column("bits").to_numpy().view(np.uint64)
    return bits


def _crowded_only(found: DataFrame, bits: np.ndarray) -> DataFrame:
    """(node, n, text_key, parity, buckets: the entries of the prefix that may be shared, with their positions), a row for each of ``found``."""
    shared = found.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            lists = batch.column(4)
            values, ends = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy().astype(np.int64)
            ends = ends - ends[0]
            slots = values.view(np.uint64) & np.uint64(len(table) * 64 - 1)
            hit = (table[(slots >> np.uint64(6)).astype(np.int64)] >> (slots & np.uint64(63))) & np.uint64(1) == 1
            at = np.arange(len(values)) - np.repeat(ends[:-1], np.diff(ends))
            entries = pa.StructArray.from_arrays([pa.array(values[hit]), pa.array(at[hit].astype(np.int32))], names=["bucket", "at"])
            kept = pa.array(np.append(0, np.cumsum(hit))[ends].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.ListArray.from_arrays(kept, entries)], names=["node", "n", "text_key", "parity", "buckets"])

    rows = found.where("n > 0").select("node", "n", "text_key", "parity", "prefix")
    return rows.mapInArrow(run, f"node long, n long, text_key long, parity binary, buckets {ENTRY}")


def _with_sets(documents: DataFrame, keys: DataFrame) -> DataFrame:
    """``keys`` (text_key and two more long columns) with the sets of their texts, by one text of each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 100):
            sets = [shingles(t.as_py()).view(np.int64) for t in part.column(2)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sets, pa.list_(pa.int64()))], names=names)

    one, two = [c for c in keys.columns if c != "text_key"]
    names = [one, two, "found"]
    texts = documents.select(F.xxhash64("text").alias("text_key"), "text").join(sized(keys), "text_key").select(one, two, "text").dropDuplicates([one, two])
    return texts.mapInArrow(run, f"{one} long, {two} long, found array<long>")


def _alike(pairs: DataFrame, keys: DataFrame) -> DataFrame:
    """The pairs (u, v) that their sketches leave."""
    of = lambda c: keys.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_parity"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = zip(*(batch.column(c).to_pylist() for c in ("u_parity", "v_parity", "u_n", "v_n")))
            yield batch.select(["u", "v"]).filter(pa.array([may_be_alike(*end) for end in ends], pa.bool_()))

    return pairs.join(of("u"), "u").join(of("v"), "v").mapInArrow(run, "u long, v long")


def _linked(documents: DataFrame, pairs: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) whose sets have the similarity: shared / (n + m - shared) >= over / under. v's set is made once. ``keys``:
    stored (node, n, text_key, parity)."""
    over, under = SHARE
    pairs, keys = scratch.stored(_alike(pairs, keys), "alike"), keys.select("node", "text_key")
    left = scratch.stored(pairs.join(keys.withColumnRenamed("node", "u"), "u").select("text_key", "u", "v"), "left")
    right = scratch.stored(pairs.select("v").distinct().join(keys.withColumnRenamed("node", "v"), "v").select("text_key", "v", F.col("v").alias("w")), "right")
    both = _with_sets(documents, left).join(_with_sets(documents, right).withColumnRenamed("found", "other"), "v")
    shared = F.size(F.array_intersect("found", "other"))
    return both.where((over + under) * shared >= over * (F.size("found") + F.size("other"))).select("u", "v")


def _may_link(n: Column, m: Column, at_n: Column, at_m: Column) -> Column:
    one, two = least_shared(n, m, at_n, at_m)
    return one & two


def relabelled(labels: DataFrame | None, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels (node, component) after more links, contracting the new links over the old components only."""
    if labels is None:
        return scratch.stored(connected_components(links, scratch.stored), "labels")
    of = lambda c: labels.withColumnsRenamed({"node": c, "component": f"{c}_component"})
    ends = links.join(sized(of("u")), "u", "left").join(sized(of("v")), "v", "left")
    merged = ends.select("u", "v", F.coalesce("u_component", "u").alias("a"), F.coalesce("v_component", "v").alias("b"))
    merged = scratch.stored(merged, "merged")
    roots = scratch.stored(connected_components(merged.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch.stored), "roots")
    every = labels.union(merged.select("u", "a")).union(merged.select("v", "b")).distinct()
    renamed = every.join(sized(roots.select(F.col("node").alias("component"), F.col("component").alias("root"))), "component", "left")
    return scratch.stored(renamed.select("node", F.coalesce("root", "component").alias("component")), "labels")


def fingerprint_pairs(documents: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs (u, v) of a node and the smallest node v of its component of near SimHash fingerprints; ``keys``: stored (node, text_key)."""
    bits = fingerprints(documents.select(F.xxhash64("text").alias("doc_id"), "text")).select(F.col("doc_id").alias("text_key"), "bits")
    named = scratch.stored(bits.join(sized(keys), "text_key").select("node", "bits").distinct(), "fingerprints")
    distinct = scratch.stored(named.select("bits").distinct(), "distinct")
    near = scratch.stored(connected_components(near_fingerprints(distinct), scratch.stored), "near-fingerprints")
    grouped = named.join(sized(near.withColumnRenamed("node", "bits")), "bits", "left").select("node", F.coalesce("component", "bits").alias("component"))
    grouped = scratch.stored(grouped, "grouped")
    hubs = scratch.stored(grouped.groupBy("component").agg(F.min("node").alias("v"), F.count("*").alias("c")).where("c > 1").select("component", "v"), "hubs")
    return grouped.join(sized(hubs), "component").where("node <> v").select(F.col("node").alias("u"), "v")


def components(documents: DataFrame, found: DataFrame, scratch: Scratch, pairs_per_row: int = 4) -> DataFrame:
    """Rows (node, component) of the nodes that have a link; ``found``: stored ``prints``. Stars go before the comparison pair
    by pair, ``STARS`` at most, while that would meet over ``pairs_per_row`` pairs for each row of a bucket."""
    spark = documents.sparkSession
    near = _crowded_only(found, crowded_bits(found)).where(F.size("buckets") > 0).groupBy("node")
    near = scratch.stored(near.agg(F.first("n").alias("n"), F.min("text_key").alias("text_key"), F.first("parity").alias("parity"), F.first("buckets").alias("buckets")), "near")
    keys, near = near.select("node", "n", "text_key", "parity"), near.select("node", "n", "buckets")
    ordered = lambda df: df.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    pairs = scratch.stored(fingerprint_pairs(documents, keys.select("node", "text_key"), scratch), "fingerprint-pairs")
    links = scratch.stored(_linked(documents, pairs, keys, scratch), "fingerprint-links")
    compared, bound = ordered(pairs), None
    labels = None if links.isEmpty() else relabelled(None, links, scratch)
    for turn in range(STARS + 1):
        labelled = near.withColumn("component", F.col("node")) if labels is None else near.join(sized(labels), "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = labelled.withColumn("crowd", F.size("buckets") / F.col("n")).select("node", "n", "component", "crowd", F.inline("buckets"))
        parts = named.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket")
        open_ = parts.agg(F.sum("c").alias("rows"), F.max(F.struct("c", "component")).alias("big")).where("rows > big.c")
        open_ = scratch.stored(open_.select("bucket", F.col("big.component").alias("big"), "rows", ((F.col("rows") - F.col("big.c")) * F.col("rows")).alias("work")), "open")
        rows, work = open_.agg(F.sum("rows"), F.sum("work")).first()
        if not rows:
            break
        bound = bound or pairs_per_row * rows
        named = scratch.stored(named.join(sized(open_.select("bucket", "big")), "bucket"), "named")
        near = named.groupBy("node", "n").agg(F.collect_list(F.struct("bucket", "at")).alias("buckets"))
        last = turn == STARS or work <= bound
        other = [F.col("node").alias("hub"), F.col("n").alias("m"), F.col("component").alias("other"), F.col("at").alias("hub_at")]
        if last:  # a bucket's rows outside its largest component against all of its rows
            met = named.where("component <> big").join(named.select("bucket", *other), "bucket")
        else:  # first the node with most of its own shingles in crowded buckets, as the text that others were copied from has; then any
            draw = F.struct((-F.col("crowd")).alias("crowd"), F.xxhash64("node").alias("draw")) if turn == 0 else F.xxhash64("node", F.lit(turn))
            hubs = named.groupBy("bucket").agg(F.min(F.struct(draw.alias("draw"), *other)).alias("hub")).select("bucket", "hub.hub", "hub.m", "hub.other", "hub.hub_at")
            met = named.join(hubs, "bucket")
        fits = (F.col("component") != F.col("other")) & _may_link(F.col("n"), F.col("m"), F.col("at"), F.col("hub_at"))
        pairs = met.where(fits).select("node", "hub")
        if last:
            pairs = pairs.select(F.least("node", "hub").alias("u"), F.greatest("node", "hub").alias("v")).distinct()
        else:
            pairs = pairs.groupBy("node", "hub").agg(F.count("*").alias("c")).groupBy("node").agg(F.max(F.struct("c", "hub")).alias("best")).select(F.col("node").alias("u"), F.col("best.hub").alias("v"))
        if last:
            pairs = pairs.join(compared, ["u", "v"], "left_anti")
        pairs = scratch.stored(pairs, "pairs")
        links = scratch.stored(_linked(documents, pairs, keys, scratch), "links")
        compared = compared.union(ordered(pairs))
        if not links.isEmpty():
            labels = relabelled(labels, links, scratch)
        if last:
            break
        near = scratch.stored(near, "near")
    return labels if labels is not None else spark.createDataFrame([], "node long, component long")


def one_per_group(documents: DataFrame, **how: int) -> DataFrame:
    """``documents`` with one row of each component, the one with the smallest (doc_id, hash of its text); columns and texts stay.

    Rows without an id stay. Texts without words are near copies of one another. Rows are told apart by id and text, so an id
    that stands for several texts loses only those that have an earlier near copy. Repeated rows are near copies: one of them stays.
    Further columns may have any name. Texts of any length are read whole, one set at a time. An empty table stays empty.
    """
    scratch = Scratch(documents.sparkSession, "near-copies")
    found = scratch.stored(prints(documents), "prints")
    labels = components(documents, found, scratch, **how)
    named = found.join(sized(labels), "node", "left").select("doc_id", "text_key", F.coalesce("component", "node").alias("component"))
    named = scratch.stored(named.where("doc_id is not null").groupBy("doc_id", "text_key", "component").agg(F.count("*").alias("times")), "named")
    first = scratch.stored(named.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("first")), "first")
    ranked = named.join(sized(first), "component").withColumn("stays", F.struct("doc_id", "text_key") == F.col("first"))
    drop = stored(ranked.where("not stays").select("doc_id", "text_key"), "drop")
    again = stored(ranked.where("stays and times > 1").select("doc_id", "text_key"), "again")
    scratch.clear()
    keyed = documents.select(*[F.col(c).alias(f"d{i}") for i, c in enumerate(documents.columns)], F.col("doc_id"), F.xxhash64("text").alias("text_key"))
    back = [F.col(f"d{i}").alias(c) for i, c in enumerate(documents.columns)]
    on = ["doc_id", "text_key"]
    kept = keyed.join(sized(drop), on, "left_anti")
    if again.isEmpty():
        return kept.select(*back)
    repeated = kept.join(sized(again), on, "left_semi").dropDuplicates(on)
    return kept.join(sized(again), on, "left_anti").select(*back).unionByName(repeated.select(*back))
