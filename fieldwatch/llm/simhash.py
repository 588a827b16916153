"""Near duplicates by SimHash fingerprints, found with vantage-point trees."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import stored
from fieldwatch.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Fingerprints a shard is meant to hold, shards of one tree at most, and sampled fingerprints per shard.
SHARD_ROWS, MOST_SHARDS, SAMPLE_PER_SHARD = 16_384, 4096, 64
LEAF = 384


def shingle_hashes(text: str, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of so many words, repeats included; of all words where there are fewer."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return np.zeros(0, "<u8")
    flat = b" ".join(words)
    if len(words) < shingle:
        return np.array([xxh64_intdigest(flat, seed)], "<u8")
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: len(words) - shingle] + 1).tolist()]
    return np.fromiter((xxh64_intdigest(flat[a:b], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist())), "<u8", len(starts))


def _majority(hashes: np.ndarray) -> int:
    """Bit i is set where over half of the hashes have it set; a single hash stands for itself."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65_536):
        part = hashes[k : k + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int, seed: int = 42) -> int:
    """Bit i is set where over half of the word shingles' hashes have it set."""
    return _majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (64 bits as a signed long) of every whole text; null counts as empty."""

    def run(batches):
        for batch in batches:
            prints = [fingerprint(t or "", shingle) for t in batch.column(1).to_pylist()]
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), signed], ["doc_id", "fingerprint"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long")


def distance(a, b):
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def _vantage(points, tries: int = 4):
    """Of a few points the one with the widest spread of distances, and the median distance."""
    best = None
    for p in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, p)
        if best is None or d.std() > best[0]:
            best = (d.std(), p, int(np.median(d)))
    return best[1], best[2]


def grow_tree(sample: np.ndarray, depth: int):
    """Vantage points and radii of a complete tree, in the order of a heap."""
    n = (1 << depth) - 1
    points, radii, held = np.zeros(n, np.uint64), np.full(n, 32, np.int16), {0: sample}
    for k in range(n):
        own = held.pop(k, sample[:0])
        if len(own):
            points[k], radii[k] = _vantage(own)
        inner = distance(own, points[k]) <= radii[k]
        held[2 * k + 1], held[2 * k + 2] = own[inner], own[~inner]
    return points, radii


def _route(prints, tree, depth, most, visiting=False):
    """(row, shard, at home) of every visit.  A fingerprint is at home in one shard.

    Where two homes part at a radius, the outer one also visits the inner side if the
    triangle inequality allows a partner there; a visitor follows every branch that
    could hold one.  So each pair within `most` bits meets in the inner one's shard.
    With `visiting`, all rows come as visitors from the start.
    """
    points, radii = tree
    row, node, home = np.arange(len(prints)), np.zeros(len(prints), np.int64), np.full(len(prints), not visiting)
    for _ in range(depth):
        d, m = distance(prints[row], points[node]), radii[node]
        inner = np.where(home, d <= m, d <= m + most)
        outer = np.where(home, d > m, d > m - most)
        visits = home & outer & (d <= m + most)
        row = np.concatenate((row[inner], row[outer], row[visits]))
        home = np.concatenate((home[inner], home[outer], np.zeros(visits.sum(), bool)))
        node = np.concatenate((2 * node[inner] + 1, 2 * node[outer] + 2, 2 * node[visits] + 1))
    return row, node - ((1 << depth) - 1), home


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n nodes."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := label[label], label):
            label = up


def _leaf_pairs(prints: np.ndarray, home: np.ndarray, most: int, leaf: int):
    """(i, j) arrays of all pairs at most so many bits apart with a row at home, each pair once.

    A tree over the shard is walked down to small leaves, with the same visiting rule;
    only there are fingerprints compared.
    """
    todo = [(np.flatnonzero(home), np.flatnonzero(~home))]
    while todo:
        own, visitors = todo.pop()
        if not len(own):
            continue
        if len(own) > leaf:
            point, m = _vantage(prints[own])
            d = distance(prints[own], point)
            if d.max() == m:
                m -= 1
            inner = d <= m
            if inner.any():
                dv = distance(prints[visitors], point)
                guests = np.concatenate((visitors[dv <= m + most], own[~inner & (d <= m + most)]))
                todo += [(own[inner], guests), (own[~inner], visitors[dv > m - most])]
                continue
        everyone = np.concatenate((own, visitors))
        step = max(1, 4_000_000 // len(everyone))
        for k in range(0, len(own), step):
            i, j = np.nonzero(np.bitwise_count(prints[own[k : k + step], None] ^ prints[None, everyone]) <= most)
            later = j > i + k
            yield own[i[later] + k], everyone[j[later]]


def shard_links(prints: np.ndarray, home: np.ndarray, most: int, leaf: int = LEAF) -> np.ndarray:
    """Label of each row: the smallest row index linked to it within a shard.

    Links are merged as they are found, so a dense cluster never becomes a list of all
    its pairs.
    """
    label = np.arange(len(prints))
    held_a, held_b, held = [], [], 0
    for a, b in _leaf_pairs(prints, home, most, leaf):
        held_a.append(a)
        held_b.append(b)
        held += len(a)
        if held > 2_000_000:
            label = _forest(len(prints), np.concatenate((np.arange(len(prints)), *held_a)), np.concatenate((label, *held_b)))
            held_a, held_b, held = [], [], 0
    return _forest(len(prints), np.concatenate((np.arange(len(prints)), *held_a)), np.concatenate((label, *held_b)))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 5,
    most_bits: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, fingerprint, component_id: documents linked by fingerprints at most so many bits apart.

    Equal fingerprints are grouped first, so copies cost one row.  The top of the tree
    is fitted on a bounded sample (SAMPLE_PER_SHARD * shards fingerprints, at most
    262,144, smallest hashes first) and only steers which shard a fingerprint goes to;
    every fingerprint is routed and the search is exact.  A shard gives back one link
    per fingerprint.  component_id is the smallest doc_id reachable, itself included.

    Null or wordless text has fingerprint 0 and is linked like any other; a null id
    keeps its fingerprint and gets a null component; rows that repeat an id are each
    linked by their own text; other columns are ignored; an empty table gives no rows.
    """
    prints = stored(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    groups = stored(prints.where("doc_id IS NOT NULL").groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "print-groups")
    n = groups.count()
    depth = int(np.ceil(np.log2(max(1, min(MOST_SHARDS, n / shard_rows)))))
    order = groups.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint")
    sample = order.limit(SAMPLE_PER_SHARD << depth).toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64) if depth else np.zeros(0, np.uint64)
    tree = grow_tree(sample, depth)

    def route(batches):
        for batch in batches:
            own = batch["fingerprint"].to_numpy(np.int64)
            row, shard, home = _route(own.view(np.uint64), tree, depth, most_bits)
            yield pd.DataFrame({"shard": shard, "fingerprint": own[row], "first": batch["first"].to_numpy()[row], "home": home})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("first", kind="stable")
        first = rows["first"].to_numpy(np.int64)
        label = shard_links(rows["fingerprint"].to_numpy(np.int64).view(np.uint64), rows["home"].to_numpy(bool), most_bits)
        moved = label != np.arange(len(label))
        return pd.DataFrame({"a": first[moved], "b": first[label[moved]]})

    visits = groups.mapInPandas(route, "shard long, fingerprint long, first long, home boolean")
    links = visits.groupBy("shard").applyInPandas(link, "a long, b long")
    found = components(links)
    named = groups.join(found, groups["first"] == found["node"], "left").select("fingerprint", F.coalesce("component", "first").alias("component_id"))
    out = prints.join(named, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame, shingle: int = 5, most_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id.

    Rows with a null id stay; rows that repeat the smallest id of a component all stay.
    """
    names = docs.columns
    work = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {c: f"c{k}" for k, c in enumerate(names)}
    decided = near_duplicates(work, shingle, most_bits, at[id_col], at[text_col])
    gone = decided.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return work.join(gone, work[at[id_col]].cast("long") == F.col("gone_id"), "left_anti").toDF(*names)
