import random
import re

import numpy as np
import pytest

from fieldwatch.llm import postings

SCHEMA = "doc_id long, text string, segment string, ids string, words string, spans string, items string, doc string"
ITEM_SCHEMA = "item_id string, text string, terms string, item string"


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def phrases_of(items, size):
    out = set()
    for item, text in items:
        w = words(text)
        k = min(size, len(w))
        out |= {(item or "", tuple(w[a : a + k])) for a in range(len(w) - k + 1) if k}
    return out


def brute(docs, items, size, reach):
    asked, out = phrases_of(items, size), []
    for doc, text in docs:
        w = words(text)
        hit, whole, near = set(), set(), set()
        for item, p in asked:
            for a in range(len(w) - len(p) + 1):
                if tuple(w[a : a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    whole.add(item)
            if any(all(t in w[max(0, a - reach) : a + reach + 1] for t in p) for a, t in enumerate(w) if t in p):
                near.add(item)
        out.append((doc, len(w), len(hit), sorted(whole), near))
    return out


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: draw.choice(["The", "the", "of", "a", "Élan", "élan", "x1", "日本", "b-c", "don't"])
    items = [(str(i), " ".join(word() for _ in range(draw.randint(1, 12)))) for i in range(12)]
    items += [("e", None), ("f", ""), (None, "zz the of"), ("g", "..."), ("10", items[3][1]), ("2", items[2][1]), ("2", "q r s")]
    docs = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(draw.randint(0, 15)))]
        for _ in range(draw.randint(0, 3)):
            parts += [(draw.choice(items)[1] or "").replace(" ", draw.choice([" ", "  ", ", ", "\n"])), word()]
        docs.append((i, " ".join(parts)))
    docs += [(None, None), (5, ""), (5, "zz\tTHE of"), (6, "the " * 5000 + docs[7][1]), *[(100 + k, "q r s") for k in range(40)]]
    return docs, items


@pytest.mark.parametrize("size", [3, 6])
def test_matches_equal_brute_force(spark, monkeypatch, size):
    """Many small segments and blocks of few phrases; helper names ride along as columns."""
    monkeypatch.setattr(postings, "SEGMENT_BYTES", 300)
    monkeypatch.setattr(postings, "BLOCK_PHRASES", 40)
    docs, items = corpus(size)
    left = spark.createDataFrame([(*d, *"abcdef") for d in docs], SCHEMA).repartition(3)
    right = spark.createDataFrame([(*i, "x", "y") for i in items], ITEM_SCHEMA)
    got = postings.contaminated(left, right, size=size)
    assert got.columns == ["doc_id", "n_words", "n_hit", "items", "near_items", "spans"]
    want = brute(docs, items, size, 0)
    key = lambda r: tuple(map(str, r))
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()], key=key) == sorted([w[:4] for w in want], key=key)


def segment(texts, block):
    """The lists of some texts, as the index stores them."""
    hashes, counts = postings.terms([t.encode() for t in texts])
    place = np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)
    order = np.argsort(hashes, kind="stable")
    known, many = np.unique(hashes, return_counts=True)
    return postings.Segment(counts, known.tobytes(), postings._planes(many), postings._planes(place[order]), block)


def test_near_matches_reach_from_the_rarest_term():
    texts = ["a b x y a c", "c a b", "b a a a c", "rare a b", "a b", "b far far far a"]
    rows = [("i", postings.terms([p.encode()])[0].tobytes()) for p in ("rare a b", "a c", "b a")]
    block = postings.Block.of(rows)
    s = segment(texts, block)
    found = {(p, d) for ph, at in s.near(block, 2) for p, d in zip(ph.tolist(), s.doc(at).tolist())}
    assert found == {(0, 3), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2), (2, 3), (2, 4)}
    whole = {(p, d) for ph, at in s.exact(block) for p, d in zip(ph.tolist(), s.doc(at).tolist())}
    assert whole == {(0, 3), (1, 0), (1, 2), (2, 2)}


def test_near_items_of_the_operator(spark):
    docs = spark.createDataFrame([(1, "one two filler three"), (2, "three x x x x x one two"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([("n", "One, three two!")], "item_id string, text string")
    got = {r.doc_id: (r.n_hit, r["items"], r.near_items) for r in postings.contaminated(docs, items, reach=3).collect()}
    assert got == {1: (0, [], ["n"]), 2: (0, [], []), 3: (0, [], [])}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([("n", "a b")], "item_id string, text string")
    assert postings.contaminated(docs.limit(0), items).count() == 0
    (row,) = postings.contaminated(docs, items.limit(0)).collect()
    assert (row.doc_id, row.n_words, row.n_hit, row["items"]) == (1, 3, 0, [])


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000)) + " needle in hay " + "tail " * 100_000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    items = spark.createDataFrame([("n", "needle in hay"), ("t", "tail tail")], "item_id string, text string")
    (row,) = postings.contaminated(docs, items).collect()
    assert (row.n_words, row.n_hit, row["items"]) == (300_003, 100_003, ["n", "t"])
