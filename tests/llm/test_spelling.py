import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from fieldwatch.llm import spelling

SCHEMA = "doc_id long, text string, word string, n long, form string, root string"


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def damaged(doc, run, damage):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % damage == 0 else run


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) < len(b):
        a, b = b, a
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute(docs, damage, least_length=5, least_count=3, ratio=2):
    n = Counter(damaged(d, r, damage) for d, t in docs for r in re.findall("[A-Za-zÀ-ÿ]+", lowered(t)))
    n = {w: c for w, c in n.items() if len(w) >= least_length and c >= least_count}
    forms, near = {}, {w: [v for v in n if one_edit(w, v)] for w in n}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= ratio * n[w] else None
    out = []
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out.append((w, forms[w], root, n[w], len(near[w]), n[forms[w]] if forms[w] else None))
    return sorted(out)


def corpus(seed, letters, n=120):
    draw = random.Random(seed)
    stems = ["".join(draw.choice(letters) for _ in range(draw.randint(4, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaa", "aaaaa", "l" * 60, "l" * 61]

    def word():
        w = list(draw.choice(stems))
        for _ in range(draw.choice([0, 0, 1, 2])):
            i = draw.randrange(len(w))
            w[i : i + draw.randint(0, 1)] = draw.choice(letters + " ")
        return "".join(w)

    docs = [(i, draw.choice([" ", "-", ", "]).join(word().capitalize() if draw.random() < 0.2 else word() for _ in range(60))) for i in range(n)]
    return docs + [(None, None), (None, docs[0][1]), (3, ""), (3, docs[1][1]), (4, "123 ... 日本"), (9, "aaaaa " * 2000 + "Ä" * 5)]


@pytest.mark.parametrize(("seed", "letters", "most"), [(1, "abÉ", 4_000), (2, "ab", 3), (3, "abcdeß", 8)])
def test_variants_equal_brute_force(spark, monkeypatch, seed, letters, most):
    """Short limits cut the lists again and again; helper names ride along as columns."""
    monkeypatch.setattr(spelling, "LIST_WORDS", most)
    monkeypatch.setattr(spelling, "TASK_ROWS", 200)
    docs = corpus(seed, letters)
    df = spark.createDataFrame([(*d, "x", 1, "y", "z") for d in docs], SCHEMA).repartition(3)
    got = spelling.variants(df, damage=7)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute(docs, 7)


def test_empty_table(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert spelling.variants(df).count() == spelling.variants(df.limit(0)).count() == 0


@pytest.mark.parametrize("letters", ["ab", "abcdefgh"])
def test_list_scan_finds_every_pair_once(letters):
    """All words of a length class share a list only where they share all but the places in question."""
    draw = random.Random(5)
    words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(6, 7))) for _ in range(250)})
    found = Counter()
    for m in (6, 7, 8):
        here = [w for w in words if len(w) in (m, m - 1)]
        if not here:
            continue
        rows = np.array([w.encode() for w in here], f"S{m}")
        for s, t in ((0, 2), (2, 3), (3, m)):
            a, b = spelling.near_in_list(rows.view(np.uint8).reshape(len(here), m), np.char.str_len(rows), m, s, t)
            found.update(frozenset((here[i], here[j])) for i, j in zip(a, b))
    want = {frozenset((v, w)) for v in words for w in words if one_edit(v, w)}
    assert found == Counter(dict.fromkeys(want, 1))
