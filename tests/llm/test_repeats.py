import hashlib
import random

import numpy as np
import pytest

from fieldwatch.llm import repeats, suffix_array, suffix_tree


def texts(seed, n=60):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abé") for _ in range(draw.randint(1, 3)))
    passages = [[word() for _ in range(draw.randint(8, 40))] for _ in range(6)]
    out = []
    for _ in range(n):
        words = []
        for _ in range(draw.randint(0, 5)):
            words += [word() for _ in range(draw.randint(0, 12))]
            p = draw.choice(passages)
            a = draw.randint(0, len(p) - 1)
            words += p[a : a + draw.randint(1, len(p))]
        out.append(draw.choice([" ", "\n", "  "]).join(words))
    return out + ["", None, "a " * 80, out[3], out[3], "same same " * 30]


def brute_words(docs, size):
    first = {}
    for k, t in docs:
        w = (t or "").encode().split()
        for i in range(len(w) - size + 1):
            key = tuple(w[i : i + size])
            first[key] = min(first.get(key, k), k)
    out = {}
    for k, t in docs:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone[i : i + size] = True
        out[k] = (len(w), int(gone.sum()), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def brute_bytes(docs, size):
    count = {}
    for _, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - size + 1):
            count[b[i : i + size]] = count.get(b[i : i + size], 0) + 1
    out = {}
    for k, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[:1].sum())
        out[k] = (len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest())
    return out


@pytest.mark.parametrize("seed, most", [(1, 50_000), (2, 3)])
def test_words_of_earlier_documents(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeats, "GROUP_RUNS", most)
    docs = list(enumerate(texts(seed)))
    df = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id long, text string, kept string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in suffix_tree.dedup_substrings(df, 6, 3).collect()}
    assert got == brute_words(docs, 6)


@pytest.mark.parametrize("seed, most", [(3, 50_000), (4, 3)])
def test_bytes_that_stand_elsewhere(spark, seed, most, monkeypatch):
    monkeypatch.setattr(repeats, "GROUP_BYTES", 3000)
    monkeypatch.setattr(repeats, "GROUP_RUNS", most)
    docs = list(enumerate(texts(seed)))
    df = spark.createDataFrame([(k, t, "c") for k, t in docs], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in suffix_array.dedup_bytes(df, 24, 9).collect()}
    assert got == brute_bytes(docs, 24)


def test_ids_that_are_null_or_repeat_and_empty_tables(spark):
    text = " ".join(f"w{k}" for k in range(60))
    df = spark.createDataFrame([(None, text), (2, text), (2, text), (5, text), (6, "short")], "doc_id long, text string")
    words = sorted((r.doc_id or 0, r.n_removed) for r in suffix_tree.dedup_substrings(df).collect())
    assert words == [(0, 0), (2, 0), (2, 0), (5, 60), (6, 0)]
    data = sorted((r.doc_id or 0, r.n_removed, r.n_bytes) for r in suffix_array.dedup_bytes(df).collect())
    assert data == [(0, 0, len(text)), (2, len(text), len(text)), (2, len(text), len(text)), (5, len(text), len(text)), (6, 0, 5)]
    assert suffix_tree.dedup_substrings(df.limit(0)).count() == 0 and suffix_array.dedup_bytes(df.limit(0)).count() == 0


def test_suffix_array_and_tree_nodes():
    r = np.random.default_rng(0)
    for k in range(120):
        t = np.concatenate((r.integers(1, r.integers(3, 7), r.integers(1, 150)), [0])).astype(np.int64)
        t = np.concatenate((np.tile(t[:-1], 3), [0])) if k % 3 == 0 else t
        rest = [tuple(t[i:]) for i in range(len(t))]
        assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=rest.__getitem__)
        depth = int(r.integers(1, 18))
        node, seen = suffix_tree.tree_nodes(t.astype(np.uint64) + 1, depth), {}
        for i in range(len(t) - depth + 1):
            seen.setdefault(rest[i][:depth], set()).add(int(node[i]))
        assert all(len(v) == 1 for v in seen.values()) and len(set().union(*seen.values())) == len(seen)


@pytest.mark.parametrize("bucketed", [2, 600, 10**9])
def test_both_ways_of_inducing_give_the_same_array(bucketed, monkeypatch):
    monkeypatch.setattr(suffix_array, "BUCKETED_ALPHABET", bucketed)
    r = np.random.default_rng(3)
    for size in (3, 5, 40, 900):
        t = np.concatenate((np.tile(r.integers(1, size, 400), 3), r.integers(1, size, 700), [0])).astype(np.int64)
        rest = [tuple(t[i:]) for i in range(len(t))]
        assert suffix_array.suffix_array(t).tolist() == sorted(range(len(t)), key=rest.__getitem__)


def test_natural_text_recurses_and_equals_brute_force(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()
    contents, size = [], 0
    while size < 150_000:
        contents.append((rows[len(contents)].text or "").encode())
        size += len(contents[-1])
    induced, levels = suffix_array._induce_suffixes, []
    monkeypatch.setattr(suffix_array, "_induce_suffixes", lambda t, *rest: levels.append(len(t)) or induced(t, *rest))
    window, data = 200, b"\0".join([*contents, b""])
    count = {}
    for c in contents:
        for i in range(len(c) - window + 1):
            count[c[i : i + window]] = count.get(c[i : i + window], 0) + 1
    want = [(d, i) for d, c in enumerate(contents) for i in range(len(c) - window + 1) if count[c[i : i + window]] > 1]
    ids = np.arange(len(contents))
    doc, lo, _ = suffix_array._compare(window)(contents, ids, ids, np.zeros(len(ids), np.int64), np.ones(len(ids), bool))
    assert want and sorted(zip(doc.tolist(), lo.tolist())) == want
    assert len(levels) >= 2 and max(levels) > 20_000

    symbols = np.concatenate((np.frombuffer(data, np.uint8).astype(np.int64) + 2, [0]))
    symbols[:-1][symbols[:-1] == 2] = 1
    sa = suffix_array.suffix_array(symbols)
    ordered = symbols.astype(">u2").tobytes()
    assert np.array_equal(np.sort(sa), np.arange(len(symbols)))
    assert all(ordered[2 * a :] < ordered[2 * b :] for a, b in zip(sa[:-1:7].tolist(), sa[1::7].tolist()))
    left = np.array([len(c) - i for c in contents for i in range(len(c) + 1)] + [0])
    before, shared = suffix_array.permuted_prefixes(symbols, sa, left, window)
    for i in range(0, len(symbols), 11):
        j, n = int(before[i]), 0
        while left[i] >= window and left[j] >= window and i != j and n < window and symbols[i + n] == symbols[j + n]:
            n += 1
        assert shared[i] == n
