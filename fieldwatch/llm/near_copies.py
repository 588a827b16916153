"""Near copies by Jaccard similarity of word shingles: SimHash finds candidates, the shingles decide."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import likely_in, stored
from fieldwatch.llm.components import components
from fieldwatch.llm.simhash import MOST_SHARDS, SAMPLE_PER_SHARD, SHARD_ROWS, _leaf_pairs, _majority, _route, grow_tree, shingle_hashes

#: Bits at which pairs are looked at: at similarity 0.8 fingerprints differ in 9.7 bits on average (deviation 2.9),
#: those of texts with up to SHORT shingles in up to 12 (deviation 3.1).
BITS, SHORT, SHORT_BITS = 20, 16, 26
#: A sketch deals a text's shingle hashes into so many bins and keeps four bits of the smallest one in each.
BINS = 256
#: Deviations by which a pair's sketches may differ more than those of texts at the least similarity do on average.
DEVIATIONS = 4
#: Size bands in a factor of 1/similarity.  A text is compared in its own band and the next so many.
BANDS = 4
LEAF = 1024
#: Hashes do not compress; a writer holds one row group in memory.
SMALL_GROUPS = {"parquet.block.size": 8 << 20, "parquet.enable.dictionary": "false"}


def sketch(hashes: np.ndarray) -> bytes:
    """BINS values of four bits: of a bin's smallest hash (ascending distinct hashes are given), 0 for an empty bin."""
    bins, first = np.unique(hashes & np.uint64(BINS - 1), return_index=True)
    out = np.zeros(BINS, np.uint8)
    out[bins.astype(np.int64)] = (hashes[first] >> np.uint64(8)) % np.uint64(15) + np.uint64(1)
    return (out[::2] | out[1::2] << 4).tobytes()


def shingle_sets(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, size (distinct shingles), sketch, shingles (sorted distinct hashes) of every whole text."""

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                hashes = [shingle_hashes(t or "", shingle) for t in part.column(1).to_pylist()]
                prints = pa.array(np.array([_majority(h) for h in hashes], np.uint64).view(np.int64))
                sets = [np.unique(h) for h in hashes]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                sketches = pa.array([sketch(h) for h in sets], pa.binary())
                flat = pa.array(np.concatenate(sets).view(np.int64))
                columns = [part.column(0), prints, pa.array(np.diff(ends)), sketches, pa.ListArray.from_arrays(pa.array(ends), flat)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "size", "sketch", "shingles"])
        pa.default_memory_pool().release_unused()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, fingerprint long, size int, sketch binary, shingles array<long>")


def _band(size, similarity: float):
    """Sizes of texts of that similarity differ by that factor at most, so their bands differ by BANDS at most."""
    return F.floor(F.log(size) * (BANDS / -np.log(similarity)) + 1e-9)


def _bins(words: np.ndarray) -> np.ndarray:
    """Values of four bits that are not zero, counted in each row of words."""
    words = words | words >> np.uint64(1)
    words |= words >> np.uint64(2)
    return np.bitwise_count(words & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)


def alike(sketches: np.ndarray, a, b, similarity: float, deviations: float) -> np.ndarray:
    """Pairs whose sketches differ in no more bins than texts of that similarity do, and some deviations.

    A bin that either text fills differs where its smallest hash is in one text only, but
    for one in 15 such cases.  A quarter of the bins rules out most pairs.
    """
    differ = (1 - similarity) * 14 / 15
    room = (differ * (1 - differ)) ** 0.5
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 50_000):
        at = np.arange(k, min(k + 50_000, len(a)))
        for part in (slice(0, BINS // 64), slice(0, BINS // 16)):
            x, y = sketches[a[at], part], sketches[b[at], part]
            filled = _bins(x | y)
            more = deviations if part.stop == BINS // 16 else max(deviations, DEVIATIONS + 1)
            at = at[_bins(x ^ y) <= differ * filled + more * room * np.sqrt(filled) + 1e-9]
        out[at] = True
    return out


def shard_candidates(prints, sizes, sketches, home, label, similarity: float, most: int, hubs: bool, leaf: int = LEAF):
    """(i, j) of candidate pairs with different labels.

    With `hubs`, each row is paired with one row only, likely a near copy.  So a large
    group is joined by as many pairs as it has rows; what that leaves apart is found by
    a second call, without `hubs`, whose labels are the groups confirmed so far.
    """
    hub = np.full(len(prints), -1)
    found_a, found_b = [], []
    for a, b in _leaf_pairs(prints, home, most, leaf):
        small, large = np.minimum(sizes[a], sizes[b]), np.maximum(sizes[a], sizes[b])
        open_ = (small >= similarity * large - 1e-9) & (label[a] != label[b])
        if hubs:
            open_ &= hub[b] < 0
        a, b = a[open_], b[open_]
        near = alike(sketches, a, b, similarity, 0 if hubs else DEVIATIONS)
        if hubs:
            a, b = a[near], b[near]
            b, first = np.unique(b, return_index=True)
            hub[b] = a[first]
        else:
            found_a.append(a[near])
            found_b.append(b[near])
    if hubs:
        b = np.flatnonzero(hub >= 0)
        return hub[b], b
    none = np.zeros(0, np.int64)
    return np.concatenate((none, *found_a)), np.concatenate((none, *found_b))


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b of the pairs whose shingle sets are that similar, decided on the whole sets."""
    pairs = stored(pairs.distinct(), "near-pairs")
    ends = stored(pairs.select(F.col("a").alias("doc_id"), F.col("a_print").alias("fingerprint")).union(pairs.select("b", "b_print")).distinct(), "near-ends")
    key = F.struct("doc_id", "fingerprint")
    # The sets of texts without a candidate, most of them, stay where they are.
    needed = likely_in(sets.select("doc_id", "fingerprint", "shingles"), key, ends, key)
    x = needed.select(F.col("doc_id").alias("a"), F.col("fingerprint").alias("a_print"), F.col("shingles").alias("a_set"))
    y = needed.select(F.col("doc_id").alias("b"), F.col("fingerprint").alias("b_print"), F.col("shingles").alias("b_set"))
    shared = F.size(F.array_intersect("a_set", "b_set")).cast("double")
    both = F.size("a_set") + F.size("b_set") - shared
    return pairs.join(y, ["b", "b_print"]).join(x, ["a", "a_print"]).where(shared >= F.lit(similarity) * both - 1e-9).select("a", "b").distinct()


def near_copies(
    docs: DataFrame,
    shingle: int = 5,
    similarity: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """doc_id, component_id: documents linked by shingle sets of Jaccard similarity `similarity` or more.

    Equal sets are grouped first.  Others are dealt by size band and, inside a large
    band, by a vantage-point tree over their SimHash fingerprints; pairs within BITS
    bits (SHORT_BITS among short texts) whose sketches agree are candidates, and the
    whole shingle sets decide about each.  At similarity 0.8 a pair is farther apart
    than that in fewer than one of 1,000 cases; nearer pairs are farther apart still
    more rarely.  Sketches refuse such a pair in fewer than one of 10,000 cases.  component_id is the smallest doc_id reachable, itself included.

    Null or wordless text has an empty set, equal to any other; a null id gets a null
    component; rows that repeat an id are each linked by their own text; an empty table
    gives no rows.  Shingles are compared by their 64-bit hashes.
    """
    spark = docs.sparkSession
    sets = stored(shingle_sets(docs, shingle, id_col, text_col), "shingle-sets", **SMALL_GROUPS)
    own_set = ["fingerprint", "size", "set_hash"]
    keyed = sets.select("doc_id", "fingerprint", "size", "sketch", F.xxhash64("shingles").alias("set_hash"))
    groups = keyed.where("doc_id IS NOT NULL").groupBy(*own_set).agg(F.min("doc_id").alias("first"), F.min("sketch").alias("sketch"))
    groups = stored(groups, "set-groups")
    # Different sets this small are never that similar.
    least = int(np.ceil(similarity / (1 - similarity) - 1e-9))
    fields = ["band", "fingerprint", "size", "sketch", "first"]
    open_ = groups.where(F.col("size") >= least).withColumn("band", _band(F.col("size"), similarity)).select(*fields)
    counts = {r.band: r.n for r in open_.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    depths = {k: int(np.ceil(np.log2(max(1, min(MOST_SHARDS, n / shard_rows))))) for k, n in counts.items()}
    deepest = max(depths.values(), default=0)
    order = open_.select("fingerprint").orderBy(F.xxhash64("fingerprint"), "fingerprint")
    sample = order.limit(SAMPLE_PER_SHARD << deepest).toPandas()["fingerprint"].to_numpy(np.int64).view(np.uint64) if deepest else np.zeros(0, np.uint64)
    tree = grow_tree(sample, deepest)
    last_short = spark.range(1).select(_band(F.lit(SHORT / similarity), similarity)).first()[0]

    def reach(band: int) -> int:
        return SHORT_BITS if band <= last_short else BITS

    def route(batches):
        for batch in batches:
            prints, bands = batch["fingerprint"].to_numpy(np.int64).view(np.uint64), batch["band"].to_numpy()
            for step in range(BANDS + 1):
                for band in np.unique(bands + step):
                    if band not in counts:
                        continue
                    at = np.flatnonzero(bands + step == band)
                    row, shard, home = _route(prints[at], tree, depths[band], reach(band), step > 0)
                    out = batch.iloc[at[row]].reset_index(drop=True)
                    out["band"], out["shard"], out["home"] = band, shard, home
                    yield out[["shard", "home", *batch.columns]]

    def finder(hubs: bool):
        def find(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["first", "fingerprint"], kind="stable")
            first, prints, home = rows["first"].to_numpy(np.int64), rows["fingerprint"].to_numpy(np.int64), rows["home"].to_numpy(bool)
            sketches = np.frombuffer(b"".join(rows["sketch"]), "<u8").reshape(len(rows), -1)
            most = reach(int(rows["band"].iloc[0]))
            a, b = shard_candidates(prints.view(np.uint64), rows["size"].to_numpy(), sketches, home, rows["label"].to_numpy(np.int64), similarity, most, hubs)
            return pd.DataFrame({"a": first[a], "a_print": prints[a], "b": first[b], "b_print": prints[b]})

        return find

    def candidates(labelled: DataFrame, hubs: bool) -> DataFrame:
        visits = labelled.mapInPandas(route, "shard long, home boolean, band long, fingerprint long, size int, sketch binary, first long, label long")
        return visits.groupBy("band", "shard").applyInPandas(finder(hubs), "a long, a_print long, b long, b_print long")

    starts = open_.withColumn("label", F.col("first"))
    links = stored(_confirmed(candidates(starts, True), sets, similarity), "near-links")
    found = stored(components(links), "near-groups")
    labelled = open_.join(found, open_["first"] == found["node"], "left").select(*fields, F.coalesce("component", "first").alias("label"))
    rest = _confirmed(candidates(labelled, False), sets, similarity)
    found = components(links.union(rest))
    named = groups.join(found, groups["first"] == found["node"], "left").select(*own_set, F.coalesce("component", "first").alias("component_id"))
    out = keyed.drop("sketch").join(named, own_set, "left")
    return out.select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay: of each component the document with the smallest id.

    Rows with a null id stay; rows that repeat the smallest id of a component all stay.
    """
    names = docs.columns
    work = docs.toDF(*[f"c{k}" for k in range(len(names))])
    at = {c: f"c{k}" for k, c in enumerate(names)}
    decided = near_copies(work, shingle, similarity, at[id_col], at[text_col])
    gone = decided.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id")).distinct()
    return work.join(gone, work[at[id_col]].cast("long") == F.col("gone_id"), "left_anti").toDF(*names)
