import numpy as np
import pytest

import corpus_pipeline
from fieldwatch.llm import near_copies, simhash
from test_simhash_components import find


def shingles(text, n=5):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def alike(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def planted(seed):
    """Texts with copies that differ in single words, in lost ends, and by more than is allowed."""
    r = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        base = r.choice(words, int(r.choice([5, 8, 9, 13, 24, 60, 150, 400]))).tolist()
        rows.append(base)
        for _ in range(k % 4):
            copy = list(base)
            for at in r.integers(0, len(copy), int(r.integers(0, 1 + len(copy) // 30)) + k % 2):
                copy[at] = str(r.choice(words))
            rows.append(copy[: len(copy) - int(r.integers(0, 1 + len(copy) // 6))])
    group = r.choice(words, 120).tolist()
    for _ in range(80):
        copy = list(group)
        copy[int(r.integers(0, 120))] = "other"
        rows.append(copy)
    texts = [" ".join(x) for x in rows]
    order = r.permutation(len(texts))
    return [texts[k] for k in order] + ["", None, " ", "one word", "ONE  word", "two words"]


@pytest.mark.parametrize("shard_rows", [12, 16_384])
def test_all_pairs_of_brute_force_are_linked(spark, shard_rows):
    texts = planted(3)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])]
    prints = [simhash.fingerprint(t or "", 5) for t in texts]
    assert sum((prints[i] ^ prints[j]).bit_count() > 3 for i, j in pairs) > 50
    want = find(pairs, range(len(texts)))
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df, shard_rows=shard_rows).collect()}
    assert got == want


def pairs_at(similarity, sizes, seed):
    """Sketches of pairs of random sets with that similarity, one pair for each size of the union."""
    r, rows = np.random.default_rng(seed), []
    for n in sizes:
        union = r.integers(0, 2**64, n, dtype=np.uint64)
        apart = n - round(similarity * n)
        rows += [np.unique(union[: n - apart // 2]), np.unique(union[apart - apart // 2 :])]
    sketches = np.frombuffer(b"".join(near_copies.sketch(x) for x in rows), "<u8").reshape(len(rows), -1)
    return sketches, np.arange(0, len(rows), 2), np.arange(1, len(rows), 2)


def test_sketches_keep_pairs_at_the_limit_and_refuse_related_ones():
    sizes = np.random.default_rng(1).integers(10, 1500, 3000)
    assert near_copies.alike(*pairs_at(0.81, sizes, 2), 0.8, near_copies.DEVIATIONS).all()
    large = sizes[sizes > 200]
    assert near_copies.alike(*pairs_at(0.56, large, 3), 0.8, near_copies.DEVIATIONS).sum() <= 3
    assert not near_copies.alike(*pairs_at(0.0, large, 4), 0.8, near_copies.DEVIATIONS).any()
    assert near_copies.alike(*pairs_at(1.0, [1, 2, 3, 400], 5), 0.8, 0).all()


def test_a_family_of_related_texts_gives_few_candidates():
    r = np.random.default_rng(7)
    base = r.integers(0, 2**64, 300, dtype=np.uint64)
    # Each text keeps 72 % of the family's shingles, so two of them share about 0.56.
    sets = [np.unique(np.concatenate((base[r.random(300) < 0.72], r.integers(0, 2**64, 1, dtype=np.uint64)))) for _ in range(800)]
    sketches = np.frombuffer(b"".join(near_copies.sketch(x) for x in sets), "<u8").reshape(len(sets), -1)
    prints = np.array([simhash._majority(x) for x in sets], np.uint64)
    sizes, label = np.array([len(x) for x in sets]), np.arange(len(sets))
    a, b = near_copies.shard_candidates(prints, sizes, sketches, np.ones(len(sets), bool), label, 0.8, 26, False)
    assert len(a) < 2 * len(sets)


def test_stage_of_the_pipeline_keeps_one_of_each_group(spark):
    texts = planted(5)
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    sets = [shingles(t) for t in texts]
    want = find([(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if alike(sets[i], sets[j])], range(len(texts)))
    assert {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, df, "").collect()} == set(want.values())


def test_ids_that_are_null_or_repeated_and_no_rows(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(None, text), (4, text), (4, "x y z"), (9, text + " end"), (2, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in near_copies.near_copies(df).collect()), key=str)
    assert got == [(2, 2), (4, 2), (4, 4), (9, 4), (None, None)]
    assert near_copies.near_copies(df.limit(0)).count() == 0
