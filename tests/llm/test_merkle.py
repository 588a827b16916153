import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from fieldwatch.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
# Names of helper columns ride along as extra columns.
EXTRA = ["tree", "chunk", "digest", "came", "path", "node", "root", "row", "position", "total", "leaves", "received"]
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, " + ", ".join(f"{c} string" for c in EXTRA)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(leaves, fanout):
    """Root, and each leaf's list of (digests before it, digests after it)."""
    paths, at, level = [[] for _ in leaves], list(range(len(leaves))), leaves
    while len(level) > 1:
        for i, place in enumerate(at):
            a = place // fanout * fanout
            paths[i].append((level[a:place], level[place + 1 : a + fanout]))
        level = [h(*level[a : a + fanout]) for a in range(0, len(level), fanout)]
        at = [place // fanout for place in at]
    return level[0], paths


def brute(rows, fanout, tampered):
    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]], fanout) for s in names}
    root, tops = tree([trees[s][0] for s in names], fanout)
    out = []
    for s, top in zip(names, tops):
        for r, path in zip(groups[s], trees[s][1]):
            node = leaf(tampered(r))
            for before, after in path + top:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), trees[s][0], root, "".join("".join(b + a) for b, a in path + top), node, node == root))
    return sorted(out, key=str)


def rows(n, sources):
    out = [(i * 3, sources[i % len(sources)], "en" if i % 4 else None, i, f"Text {i} é") for i in range(n)]
    out += [(None, sources[0], "de", 1, "No id"), (None, sources[0], None, None, None), (0, sources[0], "fr", 2, ""), (1, None, "fr", 2, "-")]
    return out + [out[3], out[3], (7, "ä", "x", 0, "Q" * 300_000), (8, "", None, None, "alone")]


def manifest(spark, data, fanout):
    df = spark.createDataFrame([(*r, *EXTRA) for r in data], SCHEMA).repartition(3)
    changed = F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))
    out = merkle.merkle_manifest(df, FIELDS, fanout=fanout, received={"text": changed})
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof", "folded_root", "verified"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def upper(r):
    return (*r[:4], r[4].upper() if r[4] is not None and r[0] is not None and r[0] % 2 == 0 else r[4])


@pytest.mark.parametrize(("n", "fanout", "sources"), [(150, 2, ["hot", "hot", "hot", "b", None]), (65, 2, ["hot"]), (140, 3, ["c", "Z", "hot", "hot", "hot"]), (90, 16, ["a", "b"])])
def test_manifest_equals_brute_force(spark, n, fanout, sources):
    """Chunks hold 8 or 27 leaves, so trees take up to four rounds and end in short nodes."""
    data = rows(n, sources)
    assert manifest(spark, data, fanout) == brute(data, fanout, upper)


def test_one_row_and_no_rows(spark):
    one = [(5, None, None, None, None)]
    (row,) = manifest(spark, one, 16)
    assert row == (5, leaf(one[0]), leaf(one[0]), leaf(one[0]), "", leaf(one[0]), True)
    df = spark.createDataFrame([], SCHEMA)
    assert merkle.merkle_manifest(df, FIELDS).count() == 0


def test_many_sources(spark):
    data = [(i, f"s{i:03}", "en", 1, "t") for i in range(120)]
    assert manifest(spark, data, 2) == brute(data, 2, upper)
