"""Windows that occur more than once, found through content-chosen anchors.

Every window of W symbols (words or bytes) is owned by one of its shorter runs of
`anchor` symbols: the one with the smallest hash, the leftmost of equals.  Which one
that is depends on the window alone, so equal windows have equal owners wherever they
stand.  Consecutive windows mostly share their owner; a run of them is one record:
the owner's hash, a hash of all symbols the run covers, the document and the place.
Records with the same owner meet in one group.  Where all of a group's records cover
the same symbols, nothing needs to be compared.  Only where they differ are the symbols
fetched, and the group's suffixes are sorted (suffix tree or suffix array).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm import arrays
from fieldwatch.llm.common import stored
from fieldwatch.llm.tokens import portions

#: Text bytes whose records are meant to meet in one group task.
GROUP_BYTES = 8_000_000
#: Bits of an owner's hash that name its group inside a bucket.
OWNER_BITS = np.uint64(40)
#: Differing runs of one owner that are sorted together; larger groups are split by their whole windows.
GROUP_RUNS = 50_000
COVERED, ASKED, COMPARED = 0, 1, 2


@dataclass(frozen=True)
class Windows:
    """What counts as a repeated window.

    unit: "word" or "byte"; size: symbols in a window; anchor: symbols in an owner;
    first_stays: a window is repeated if a smaller doc_id has it too, otherwise if it
    stands anywhere else.
    """

    unit: str
    size: int
    anchor: int
    first_stays: bool


def symbols(texts: list[bytes], unit: str):
    """Value of each symbol of all texts in turn; first symbol and end of each text."""
    data, offsets = arrays.joined(texts)
    if unit == "byte":
        return arrays.BYTES[data], offsets[:-1], offsets[1:] - 1
    _, _, hashes, first = arrays.words(data, offsets)
    return hashes, first[:-1], first[1:]


def runs(values, begins, ends, rule: Windows):
    """Runs of windows with one owner: owner hash, cover hash, text, first window in it, windows."""
    n, w, k = len(values), rule.size, rule.anchor
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    counts = np.maximum(ends - begins - w + 1, 0)
    if not counts.any():
        return none
    sums = arrays.prefix_sums(values)
    grams = arrays.mixed((sums[k:] - sums[: n - k + 1]) * arrays.powers(arrays.INVERSE, n)[: n - k + 1])
    keys = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    owner = (arrays.sliding_minimum(keys, w - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    text = np.repeat(np.arange(len(begins)), counts)
    start = np.repeat(begins - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(len(text))
    mine = owner[start]
    new = np.flatnonzero(np.concatenate(([True], (mine[1:] != mine[:-1]) | (text[1:] != text[:-1]))))
    length = np.diff(np.concatenate((new, [len(text)])))
    lo, own, of = start[new], mine[new], text[new]
    cover = arrays.window_hashes(sums, lo, lo + length + w - 1)
    cover = arrays.mixed(cover ^ (length.astype(np.uint64) << np.uint64(32)) ^ (own - lo).astype(np.uint64))
    return grams[own], cover, of, lo - begins[of], length


def _planes(column: np.ndarray) -> bytes:
    """Bytes of a column by significance: high bytes, mostly zero, compress away."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def _unplanes(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, n).T).view(kind).ravel()


#: Packed columns: kind in memory and bytes that are kept of it.
COLUMNS = (("owner", "<u8", 5), ("cover", "<u8", 8), ("doc", "<i8", 8), ("lo", "<i8", 5), ("n", "<i8", 2), ("many", "<i8", 1))


def _pack(columns) -> bytes:
    return b"".join(_planes(c.astype(kind))[: width * len(c)] for c, (_, kind, width) in zip(columns, COLUMNS))


def _unpack(blob: bytes, n: int):
    at, out = 0, []
    for _, kind, width in COLUMNS:
        size = np.dtype(kind).itemsize
        out.append(_unplanes(blob[at : at + width * n] + bytes((size - width) * n), n, kind))
        at += width * n
    return out


def combined(owner, cover, doc, lo, n, first_stays: bool):
    """What a portion of documents can tell by itself, before anything is shuffled.

    Returns the records that still have to meet others, and those known to be repeated.
    Of runs with equal symbols only the smallest document's go on (or one of them, marked
    `many`, where the first does not stay), so a passage that a third of all documents
    share costs a few records for each portion.
    """
    order = np.lexsort((lo, doc, cover, owner))
    owner, cover, doc, lo, n = (x[order] for x in (owner, cover, doc, lo, n))
    new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (cover[1:] != cover[:-1])))
    head = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    sizes = np.diff(np.concatenate((head, [len(owner)])))
    many = (sizes > 1)[of].astype(np.int64)
    if first_stays:
        known = doc > doc[head][of]
        go, many = ~known, np.zeros_like(many)
    else:
        known, go = many > 0, new
    columns = (owner, cover, doc, lo, n, many)
    return [c[go] for c in columns], [c[known] for c in columns]


def records(docs: DataFrame, rule: Windows, buckets: int) -> DataFrame:
    """bucket, n, known, blob: the runs of each portion of documents, packed by bucket of their owner.

    Runs known to be repeated only pass through, in a bucket that follows from the portion.
    """

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
            for a, b in portions(texts, 800_000):
                values, begins, ends = symbols([t.encode("utf-8", "replace") for t in texts[a:b]], rule.unit)
                owner, cover, text, lo, n = runs(values, begins, ends, rule)
                if not len(owner):
                    continue
                open_, known = combined(owner, cover, ids[a:b][text], lo, n, rule.first_stays)
                bucket = (open_[0] >> OWNER_BITS).astype(np.int64) % buckets
                order = np.argsort(bucket, kind="stable")
                open_[0] = open_[0] & np.uint64((1 << 40) - 1)
                columns, bucket = [x[order] for x in open_], bucket[order]
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
                rows = [(int(bucket[x]), int(y - x), False, _pack([c[x:y] for c in columns])) for x, y in zip(cut, cut[1:])]
                if len(known[0]):
                    rows.append((int(owner[0] % np.uint64(buckets)), len(known[0]), True, _pack(known)))
                kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["bucket", "n", "known", "blob"])

    return docs.mapInArrow(run, "bucket long, n long, known boolean, blob binary")


def judge(owner, cover, doc, many, first_stays: bool):
    """Of records sorted by (owner, cover, doc): which are repeated, and which must be compared."""
    same_owner = np.concatenate(([False], owner[1:] == owner[:-1]))
    same_cover = same_owner & np.concatenate(([False], cover[1:] == cover[:-1]))
    kind_of = np.cumsum(~same_cover) - 1
    heads = np.flatnonzero(~same_cover)
    sizes = np.diff(np.concatenate((heads, [len(owner)])))
    group_of = np.cumsum(~same_owner) - 1
    kinds = np.bincount(group_of[heads], minlength=group_of[-1] + 1 if len(owner) else 0)
    twice = (sizes > 1) | (np.maximum.reduceat(many, heads) > 0) if len(heads) else sizes > 1
    repeated = doc > doc[heads][kind_of] if first_stays else twice[kind_of]
    differs = kinds[group_of] > 1
    what = np.full(len(owner), -1, np.int64)
    what[differs & ~repeated] = ASKED
    what[repeated] = COVERED
    partner = np.zeros(0, np.int64)
    if not first_stays:  # one of a repeated kind stands for it in the comparison
        partner = heads[twice & (kinds[group_of[heads]] > 1)]
    return what, partner


def spans_of_groups(packed: DataFrame, rule: Windows) -> DataFrame:
    """doc, lo, n, what, owner: runs known to be repeated, and runs to compare by symbols."""

    def solve(key, group):
        parts = [(known, _unpack(blob, n)) for blob, n, known in zip(group["blob"], group["n"], group["known"])]
        none = [np.zeros(0, kind) for _, kind, _ in COLUMNS]
        owner, cover, doc, lo, n, many = (np.concatenate(c) for c in zip(none, *[p for known, p in parts if not known]))
        sure = [np.concatenate(c) for c in zip(none, *[p for known, p in parts if known])]
        # Most owners stand alone; they are set aside before the full sort.
        order = np.argsort(owner, kind="stable")
        own = owner[order]
        twin = np.concatenate(([False], own[1:] == own[:-1]))[: len(own)]
        twin[:-1] |= twin[1:].copy()
        order = order[twin]
        owner, cover, doc, lo, n, many = (x[order] for x in (owner, cover, doc, lo, n, many))
        order = np.lexsort((lo, doc, cover, owner))
        owner, cover, doc, lo, n, many = (x[order] for x in (owner, cover, doc, lo, n, many))
        what, partner = judge(owner, cover, doc, many, rule.first_stays)
        at = np.flatnonzero(what >= 0)
        pick = np.concatenate((at, partner))
        kind = np.concatenate((what[at], np.full(len(partner), COMPARED), np.full(len(sure[0]), COVERED)))
        group_id = (np.int64(key[0]) << np.int64(40)) | owner[pick].astype(np.int64)
        return pd.DataFrame(
            {"doc": np.concatenate((doc[pick], sure[2])), "lo": np.concatenate((lo[pick], sure[3])), "n": np.concatenate((n[pick], sure[4])), "what": kind, "owner": np.concatenate((group_id, np.zeros(len(sure[0]), np.int64)))}
        )

    return packed.groupBy("bucket").applyInPandas(solve, "doc long, lo long, n long, what long, owner long")


def contents(docs: DataFrame, open_runs: DataFrame, rule: Windows) -> DataFrame:
    """The symbols of runs to compare: owner, doc, lo, n, what, content (bytes, or 8-byte word hashes)."""
    wanted = open_runs.groupBy("doc").agg(F.collect_list(F.struct("owner", "lo", "n", "what")).alias("wanted"))

    def fetch(batches):
        for batch in batches:
            out = []
            for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = text.encode("utf-8", "replace")
                if rule.unit == "word":
                    data, width = symbols([data], "word")[0].tobytes(), 8
                else:
                    width = 1
                for r in wanted:
                    out.append((r["owner"], doc, r["lo"], r["n"], r["what"], data[width * r["lo"] : width * (r["lo"] + r["n"] + rule.size - 1)]))
                if len(out) > 20_000:
                    yield _batch(out)
                    out = []
            if out:
                yield _batch(out)

    def _batch(rows):
        kinds = [pa.int64()] * 5 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["owner", "doc", "lo", "n", "what", "content"])

    joined = docs.join(wanted, "doc").select("doc", "text", "wanted")
    return joined.mapInArrow(fetch, "owner long, doc long, lo long, n long, what long, content binary")


def split_groups(asked: DataFrame, rule: Windows) -> DataFrame:
    """Repeated windows of groups too large to be sorted together: doc, lo, n.

    The prefix that splits suffixes is lengthened to the whole window: each window is a
    row with its 128-bit hash, counted by partial aggregates and joined back, so a window
    that stands in a third of all documents is split like any hot key.
    """

    def explode(batches):
        for batch in batches:
            docs, los, asks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "lo", "what"))
            for k, content in enumerate(batch.column("content").to_pylist()):
                values = arrays.BYTES[np.frombuffer(content, np.uint8)] if rule.unit == "byte" else np.frombuffer(content, "<u8")
                at = np.arange(len(values) - rule.size + 1)
                one, two = (arrays.window_hashes(arrays.prefix_sums(v), at, at + rule.size).view(np.int64) for v in (values, arrays.mixed(values)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(one), pa.array(two), pa.array(np.full(len(at), docs[k])), pa.array(los[k] + at), pa.array(np.full(len(at), asks[k] == ASKED))], ["h1", "h2", "doc", "lo", "asked"]
                )

    windows = stored(asked.select("doc", "lo", "what", "content").mapInArrow(explode, "h1 long, h2 long, doc long, lo long, asked boolean"), "hot-windows")
    seen = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("times"), F.min("doc").alias("first"))
    hit = F.col("first") < F.col("doc") if rule.first_stays else F.col("times") > 1
    return windows.where("asked").join(seen, ["h1", "h2"]).where(hit).select("doc", "lo", F.lit(1).cast("long").alias("n"))


def repeated_spans(docs: DataFrame, rule: Windows, compare, id_col: str, text_col: str) -> DataFrame:
    """doc, spans: places (lo, n) of repeated windows, n consecutive ones from lo on.

    `compare(contents, docs, lo, n, asked)` gets a group's differing contents and returns
    the repeated windows among the asked ones as (doc, lo, n) arrays.
    """
    plain = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // GROUP_BYTES))
    found = stored(spans_of_groups(records(plain, rule, buckets), rule), "repeats")
    asked = contents(plain, found.where(F.col("what") > COVERED), rule)

    def solve(key, group):
        group = group.sort_values(["owner", "doc", "lo"], kind="stable")
        doc, lo, n = compare(
            group["content"].to_list(), group["owner"].to_numpy(np.int64), group["doc"].to_numpy(np.int64), group["lo"].to_numpy(np.int64), group["what"].to_numpy() == ASKED
        )
        return pd.DataFrame({"doc": doc, "lo": lo, "n": n})

    large = stored(found.where(F.col("what") > COVERED).groupBy("owner").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > GROUP_RUNS).select("owner"), "large-groups")
    every = found.where(F.col("what") == COVERED).select("doc", "lo", "n")
    if not large.isEmpty():
        asked = stored(asked.join(large.withColumn("large", F.lit(True)), "owner", "left"), "contents")
        every = every.unionByName(split_groups(asked.where("large"), rule))
        asked = asked.where("large IS NULL")
    dealt = asked.withColumn("bucket", F.pmod(F.xxhash64("owner"), F.lit(8 * buckets)))
    more = dealt.groupBy("bucket").applyInPandas(solve, "doc long, lo long, n long")
    every = every.unionByName(more)
    return every.groupBy("doc").agg(F.collect_list(F.struct("lo", "n")).alias("spans"))


def covered(length: int, lo, n, size: int) -> np.ndarray:
    """Which of `length` symbols lie in one of the windows."""
    edge = np.zeros(length + 1, np.int64)
    np.add.at(edge, np.minimum(lo, length), 1)
    np.add.at(edge, np.minimum(np.asarray(lo) + np.asarray(n) + size - 1, length), -1)
    return np.cumsum(edge[:-1]) > 0
