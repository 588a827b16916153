import numpy as np
import pytest
from xxhash import xxh64_intdigest

from fieldwatch.llm import simhash
from fieldwatch.llm.components import components


def find(pairs, nodes):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_of_chains_stars_and_loops(spark):
    pairs = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (200, 201), (200, 201), (150, 40)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r.node: r.component for r in components(df).collect()}
    nodes = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    assert got == find([p for p in pairs if None not in p], nodes)
    assert components(df.limit(0)).count() == 0


def brute_print(text, shingle):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text).encode().split()
    parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxh64_intdigest(p, 42) for p in parts]
    return sum((2 * sum(h >> i & 1 for h in hashes) > len(hashes)) << i for i in range(64)) if hashes else 0


@pytest.mark.parametrize("text", ["", " \n", "One", "one TWO", "a b c", "É a É a É a b", "x " * 300, "a b c d"])
def test_fingerprint(text):
    assert simhash.fingerprint(text, 3) == brute_print(text, 3)


def clustered(seed, n):
    r = np.random.default_rng(seed)
    seeds = r.integers(0, 2**63, 40, dtype=np.uint64)
    out = set()
    while len(out) < n:
        x = int(r.choice(seeds)) if r.random() < 0.7 else int(r.integers(0, 2**63))
        for bit in r.integers(0, 64, r.integers(0, 5)):
            x ^= 1 << int(bit)
        out.add(x)
    return np.array(sorted(out), np.uint64)


@pytest.mark.parametrize("most", [0, 2, 3])
def test_shard_links_are_exact(most):
    prints = clustered(most, 1500)
    pairs = [(i, j) for i in range(len(prints)) for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= most).tolist() if j > i]
    label = simhash.shard_links(prints, np.ones(len(prints), bool), most, leaf=16)
    assert dict(enumerate(label.tolist())) == find(pairs, range(len(prints)))


def test_routing_brings_every_pair_together():
    prints = clustered(9, 1200)
    depth, most = 5, 2
    row, shard, home = simhash._route(prints, simhash.grow_tree(prints[::7], depth), depth, most)
    assert sorted(row[home].tolist()) == list(range(len(prints)))
    meets = set()
    for s in set(shard.tolist()):
        own, all_ = row[(shard == s) & home], row[shard == s]
        meets |= {(min(a, b), max(a, b)) for a in own.tolist() for b in all_.tolist()}
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints ^ prints[i]) <= most).tolist():
            assert i == j or (min(i, j), max(i, j)) in meets


def test_near_duplicates_over_many_shards(spark):
    r = np.random.default_rng(2)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(120):
        base = r.choice(words, 200).tolist()
        rows.append(" ".join(base))
        if k % 3 == 0:
            base[5] = "other"
            rows += [" ".join(base), " ".join(base)]
    rows += ["", None, " ", "one word"]
    df = spark.createDataFrame([(k, t, "c") for k, t in enumerate(rows)], "doc_id long, text string, fingerprint string")
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.near_duplicates(df, 3, 4, shard_rows=20).collect()}
    prints = {k: brute_print(t or "", 3) for k, t in enumerate(rows)}
    pairs = [(i, j) for i in prints for j in prints if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    want = find(pairs, prints)
    assert {k: (f % 2**64, c) for k, (f, c) in got.items()} == {k: (prints[k], want[k]) for k in prints}
    left = {x.doc_id for x in simhash.drop_near_duplicates(df, 3, 4).collect()}
    assert left == set(want.values())
    assert simhash.near_duplicates(df.limit(0), 3, 2).count() == 0


def test_null_ids_keep_their_fingerprint(spark):
    df = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c")], "doc_id long, text string")
    rows = simhash.near_duplicates(df, 3, 2).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in rows) == [(False, 4), (False, 4), (True, None)]
    assert simhash.drop_near_duplicates(df).count() == 3
