import random

import numpy as np
import pytest
import xxhash

from tests.llm.helpers import awkward, documents, frame, prose
from voxelweave.llm import simhash_vptree as sv
from voxelweave.llm.components import connected_components

SMALL = dict(sample_rows=64, leaf_rows=4, shard_rows=16)


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(values):
    """values: {key: fingerprint}; smallest key reachable."""
    keys = sorted(values)
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if (values[a] ^ values[b]).bit_count() <= 4 and root[b] > root[a]:
                    root[b] = root[a]
                    changed = True
    return root


@pytest.mark.parametrize("text", ["", None, "Just two", "one two three four", prose(1, 3), prose(2, 300), "Écoute l'ÉTÉ\x0bDE\x0cla\r\nmer  encore"])
def test_fingerprint(text):
    assert sv.fingerprint(text) == plain_fingerprint(text)


def near_points(seed, n):
    rng = random.Random(seed)
    points = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        p = rng.choice(points)
        for bit in rng.sample(range(64), rng.randrange(1, 7)):
            p ^= 1 << bit
        points.append(p)
    return sorted(set(points))


@pytest.mark.parametrize("max_bits,blocks", [(4, 3), (4, 1), (7, 2)])
def test_links_close_to_all_pairs(spark, max_bits, blocks):
    points = np.array(near_points(3, 250), np.uint64)
    table = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "bits long")
    edges = sv.links(table, max_bits, blocks=blocks, **SMALL)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    signed = points.view(np.int64)
    near = np.bitwise_count(points[:, None] ^ points[None, :]) <= max_bits
    label = np.arange(len(points))
    for _ in range(len(points)):
        label = np.array([label[near[i]].min() for i in range(len(points))])
    groups = {}
    for value, group in zip(signed.tolist(), label.tolist()):
        groups.setdefault(group, []).append(value)
    want = {v: min(g) for g in groups.values() if len(g) > 1 for v in g}
    assert got == want


def test_dense_ball_gives_few_edges():
    rng = random.Random(5)
    centre = rng.getrandbits(64)
    points = np.array(sorted({centre ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)}), np.uint64)
    u, v = sv.local_links(points.view(np.int64), 4)
    assert len(u) == len(points) - 1 and len(set(v.tolist())) == 1


def test_awkward_rows(spark):
    rows = awkward() + [(20, prose(4, 80) + " tail"), (21, prose(21, 80))]
    got = frame(sv.near_duplicates(documents(spark, rows, bits=1, component=2, least=3), **SMALL))
    assert list(got.columns) == ["doc_id", "fingerprint", "component_id"] and len(got) == len(rows)
    want = {}
    for doc_id, text in rows:
        want.setdefault(doc_id, plain_fingerprint(text))
    known = {k: v for k, v in want.items() if k is not None}
    roots = plain_components(known)
    for row in got.itertuples():
        if row.doc_id == row.doc_id:
            assert row.fingerprint == f"{known[int(row.doc_id)]:016x}" and row.component_id == roots[int(row.doc_id)]
    assert roots[1] == roots[2] == roots[3] == 1 and roots[5] == 4


def test_nulls_alone_and_empty(spark):
    got = frame(sv.near_duplicates(documents(spark, [(None, "a b c d e f g h")]), **SMALL))
    assert got.component_id.isna().all() and len(got) == 1
    assert sv.near_duplicates(documents(spark, []), **SMALL).count() == 0


def test_one_per_group_keeps_columns(spark):
    df = documents(spark, awkward(), count=7)
    kept = sv.one_per_group(df, **SMALL)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 8), (False, 9), (False, 10), (True, 0), (True, 0)]


def test_components_of_a_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(5, i) for i in range(1000, 1200)] + [(1100, 3), (7, 7), (None, 4)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(path + hub, "u long, v long")).collect()))
    assert got == {i: 100 for i in range(100, 161)} | {i: 3 for i in [3, 5, *range(1000, 1200)]}
