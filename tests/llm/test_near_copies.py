import random

import pytest

from tests.llm.helpers import awkward, documents, prose
from voxelweave.llm import near_copies as nc


def plain_set(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept_rows(rows):
    """Smallest (doc_id, text) of each component of brute-force Jaccard 0.8 or more; ids are not null."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(top(i), []).append(row)
    return sorted(min(g) for g in groups.values())


def plain_kept(rows):
    return [r[0] for r in plain_kept_rows(rows)]


def edited(text, changes, rng):
    words = text.split()
    for at in rng.sample(range(len(words)), changes):
        words[at] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def copies(seed=3, groups=12, each=9):
    rng, rows = random.Random(seed), []
    for g in range(groups):
        base = prose(f"base{g}", rng.randrange(30, 400))
        rows.append(base)
        rows += [edited(base, max(1, len(base.split()) * rng.randrange(1, 4) // 100), rng) for _ in range(each)]
        rows.append(" ".join(base.split()[: len(base.split()) * 83 // 100]))  # a lead of the text: similarity just over 0.8
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("pairs_per_row", [1000, 0])
def test_kept_rows_equal_brute_force(spark, pairs_per_row):
    rows = copies()
    want = plain_kept(rows)
    got = sorted(r.doc_id for r in nc.one_per_group(documents(spark, rows), pairs_per_row=pairs_per_row).collect())
    assert got == want and len(want) < len(rows)


def test_one_id_on_two_texts_and_awkward_rows(spark):
    a, b, other = prose("a", 90), prose("b", 90), prose("c", 90)
    rows = [(1, a), (2, a + " end"), (2, b), (3, b + " tail"), (5, other), (4, prose("d", 90)), (4, prose("e", 90))]
    got = sorted((r.doc_id, r.text) for r in nc.one_per_group(documents(spark, rows, bucket=1, node=2)).collect())
    assert got == sorted([(1, a), (2, b), (5, other), (4, prose("d", 90)), (4, prose("e", 90))])
    df = documents(spark, awkward(), count=7)
    kept = nc.one_per_group(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 1), (False, 4), (False, 6), (False, 8), (False, 9), (False, 10), (True, 0), (True, 0)]
    assert nc.one_per_group(documents(spark, [])).count() == 0


def test_prefix_filter_misses_no_pair():
    """Sets at the very threshold, with their common elements last in the order of rarity."""
    import numpy as np

    rng = random.Random(9)
    for n in (1, 2, 4, 5, 9, 10, 45, 100, 999):
        for m in range(n, n * 5 // 4 + 1):
            shared = -(-4 * (n + m) // 9)
            if shared > n:
                continue
            pool = rng.sample(range(1, 1 << 60), n + m - shared)
            a, b = np.array(sorted(pool[:n]), np.uint64), np.array(sorted(pool[n - shared :]), np.uint64)
            classes = np.zeros(nc.SLOTS, np.uint8)
            classes[[h & (nc.SLOTS - 1) for h in pool[n - shared : n]]] = 9
            first_a, first_b = nc.prefix(a, classes).tolist(), nc.prefix(b, classes).tolist()
            common = set(first_a) & set(first_b)
            assert common
            assert any(all(nc.least_shared(n, m, first_a.index(h), first_b.index(h))) for h in common)


def test_fingerprint_trees_propose_near_copies(spark, monkeypatch):
    """The vantage-point trees link near copies first; whole sets refuse what only looks alike, and the prefix filter adds the rest."""
    from voxelweave.llm.common import Scratch

    rows = copies(seed=8, groups=6, each=5)
    df = documents(spark, rows)
    scratch = Scratch(spark, "test")
    found = scratch.stored(nc.prints(df), "prints")
    keys = scratch.stored(found.groupBy("node").agg({"text_key": "min"}).toDF("node", "text_key"), "keys")
    proposed = nc.fingerprint_pairs(df, keys, scratch).collect()
    assert proposed and all(p.u > p.v for p in proposed)
    one_print = monkeypatch.setattr(nc, "fingerprints", lambda docs: docs.selectExpr("doc_id", "0L as bits"))  # all alike
    assert one_print is None
    got = sorted(r.doc_id for r in nc.one_per_group(df).collect())
    assert got == plain_kept(rows)
    scratch.clear()


def test_sketches_refuse_no_alike_pair_and_few_sets_are_made(spark):
    """Sketches of different lengths at the very threshold; texts that share one rare passage only are told apart without their sets."""
    import numpy as np

    from voxelweave.llm.common import Scratch

    rng = random.Random(11)
    for n in (1, 4, 45, 60, 64, 65, 120, 999, 4090):
        for m in {n, n * 9 // 8, n * 5 // 4}:
            shared = -(-4 * (n + m) // 9)
            if shared > n:
                continue
            pool = rng.sample(range(1, 1 << 60), n + m - shared)
            a, b = np.array(pool[:n], np.uint64), np.array(pool[n - shared :], np.uint64)
            assert nc.may_be_alike(nc.parity(a), nc.parity(b), n, m) and nc.may_be_alike(nc.parity(b), nc.parity(a), m, n)
            other = np.array(rng.sample(range(1, 1 << 60), m), np.uint64)
            assert n < 45 or not nc.may_be_alike(nc.parity(a), nc.parity(other), n, m)

    passage = "a rare passage of seven words here"
    df = documents(spark, list(enumerate([f"{passage} {prose(f'text{i}', 60 + i)}" for i in range(8)])))
    scratch = Scratch(spark, "test")
    found = scratch.stored(nc.prints(df), "prints")
    pairs = found.selectExpr("node as u").crossJoin(found.selectExpr("node as v")).where("u < v")
    assert nc._linked(df, pairs, found.select("node", "n", "text_key", "parity"), scratch).count() == 0
    made = [spark.read.parquet(f"{scratch.path}/{k}-{name}").count() for k, name in ((3, "left"), (4, "right"))]
    assert pairs.count() == 28 and made == [0, 0]
    scratch.clear()
