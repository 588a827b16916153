"""De-duplication of repeated byte strings by suffix arrays, built by induced sorting."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm import arrays
from fieldwatch.llm.repeats import Windows, covered, repeated_spans

WINDOW, ANCHOR = 200, 60
#: Alphabets up to this size are induced a bucket at a time, larger ones, in recursion, a suffix at a time.
BUCKETED_ALPHABET = 600


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last is."""
    n = len(t)
    change = np.where(t[1:] != t[:-1], np.arange(n - 1), n)
    at = np.minimum.accumulate(change[::-1])[::-1]
    out = np.ones(n, bool)
    known = at < n
    out[:-1][known] = t[at[known]] < t[at[known] + 1]
    return out


def _induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """Suffix array from the sorted leftmost-smaller suffixes."""
    return (_induce_buckets if size <= BUCKETED_ALPHABET else _induce_suffixes)(t, small, leftmost, size)


def _induce_suffixes(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """The same, one suffix at a time: with many symbols the buckets are too small to be moved whole."""
    ends = np.cumsum(np.bincount(t, minlength=size))
    head, tail = np.concatenate(([0], ends[:-1])).tolist(), ends.tolist()
    symbol, is_small, out = t.tolist(), small.tolist(), [-1] * len(t)
    for place in leftmost[::-1].tolist():
        c = symbol[place]
        tail[c] -= 1
        out[tail[c]] = place
    out[0] = len(t) - 1
    for k in range(len(t)):
        place = out[k] - 1
        if place >= 0 and not is_small[place]:
            c = symbol[place]
            out[head[c]] = place
            head[c] += 1
    tail = ends.tolist()
    for k in range(len(t) - 1, -1, -1):
        place = out[k] - 1
        if place >= 0 and is_small[place]:
            c = symbol[place]
            tail[c] -= 1
            out[tail[c]] = place
    return np.array(out, np.int64)


def _induce_buckets(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """The same, one symbol's bucket at a time.

    All entries of a bucket that are known are moved on at once; entries that fall into
    the same bucket make the next wave.
    """
    n = len(t)
    count = np.bincount(t, minlength=size)
    begin = np.cumsum(count) - count
    head, tail = begin.copy(), begin + count
    sa = np.full(n, -1, np.int64)
    chars = np.flatnonzero(count)
    cut = np.searchsorted(t[leftmost], np.arange(size + 1))

    def dealt(entries, larger):
        before = entries[entries > 0] - 1
        before = before[small[before] != larger]
        symbol = t[before]
        order = np.argsort(symbol, kind="stable")
        symbol, before = symbol[order], before[order]
        many = np.bincount(symbol, minlength=size)
        return before, symbol, np.arange(len(before)) - (np.cumsum(many) - many)[symbol], many

    for c in chars:
        done = begin[c]
        while done < head[c]:
            wave, done = sa[done : head[c]], head[c]
            before, symbol, rank, many = dealt(wave, True)
            sa[head[symbol] + rank] = before
            head += many
        before, symbol, rank, many = dealt(leftmost[cut[c] : cut[c + 1]], True)
        sa[head[symbol] + rank] = before
        head += many
    for c in chars[::-1]:
        done = begin[c] + count[c]
        while done > tail[c]:
            wave, done = sa[tail[c] : done][::-1], tail[c]
            before, symbol, rank, many = dealt(wave, False)
            sa[tail[symbol] - 1 - rank] = before
            tail -= many
        before, symbol, rank, many = dealt(sa[begin[c] : head[c]][::-1], False)
        sa[tail[symbol] - 1 - rank] = before
        tail -= many
    sa[0] = n - 1
    return sa


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Suffixes of t in order.

    t: whole numbers that end in a unique 0.  Suffixes are classified as smaller or
    larger than the next; the substrings between leftmost-smaller places are sorted by
    inducing and named by content; the names form a text of a third of the length, whose
    suffixes are sorted recursively; the rest is induced from them in linear time.
    """
    size, small = int(t.max()) + 1, _types(t)
    place = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(place) < 2:
        return _induce(t, small, place, size)
    is_place = np.zeros(len(t), bool)
    is_place[place] = True
    rough = _induce(t, small, place[np.argsort(t[place], kind="stable")], size)
    order = rough[is_place[rough]]
    ends = np.concatenate((place[1:] + 1, [len(t)]))
    content = arrays.window_hashes(arrays.prefix_sums(t.astype(np.uint64) * arrays.BYTES[7] + arrays.BYTES[11]), place, ends)
    number = np.zeros(len(t), np.int64)
    number[place] = np.arange(len(place))
    at = number[order]
    length = ends - place
    new = (content[at][1:] != content[at][:-1]) | (length[at][1:] != length[at][:-1])
    name = np.empty(len(place), np.int64)
    name[at] = np.concatenate(([0], np.cumsum(new)))
    if not new.all():
        order = place[suffix_array(name)]
    return _induce(t, small, order, size)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, left: np.ndarray, most: int):
    """Predecessor of each suffix in the array, and their common prefix in text order, cut at `most`.

    Symbols are compared eight at a time, and only while a pair agrees.  Where a separator
    or the end lies nearer than `most` on either side, or there is no predecessor, the
    prefix counts as 0.
    """
    before = np.empty(len(t), np.int64)
    before[sa[1:]], before[sa[0]] = sa[:-1], sa[0]
    padded = np.concatenate((t & 255, np.zeros(most + 16, np.int64))).astype(np.uint64)
    eight = np.zeros(len(padded) - 7, np.uint64)
    for k in range(8):
        eight |= padded[k : len(eight) + k] << np.uint64(8 * k)
    shared = np.zeros(len(t), np.int64)
    here = np.flatnonzero((left >= most) & (left[before] >= most) & (np.arange(len(t)) != before))
    for k in range(0, most, 8):
        apart = eight[here + k] ^ eight[before[here] + k]
        lowest = apart & (~apart + np.uint64(1))
        shared[here] = k + np.where(apart == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8)
        here = here[apart == 0]
    return before, np.minimum(shared, most)


def repeated_starts(t: np.ndarray, left: np.ndarray, window: int) -> np.ndarray:
    """Where the next `window` symbols, all before a separator, stand elsewhere too.

    left: symbols up to the next separator.  A place is repeated if it reaches that far
    with its predecessor in the suffix array, or its successor does with it.
    """
    before, shared = permuted_prefixes(t, suffix_array(t), left, window)
    here = np.flatnonzero(shared >= window)
    out = np.zeros(len(t), bool)
    out[here] = out[before[here]] = True
    return out


def _compare(window: int):
    def compare(contents, owner, doc, lo, asked):
        sizes = np.array([len(c) for c in contents])
        data = np.frombuffer(b"\0".join([*contents, b""]), np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        t = np.concatenate((data.astype(np.int64) + 2, [0]))
        t[ends] = 1
        left = np.repeat(ends, sizes + 1) - np.arange(len(data))
        hit = repeated_starts(t, np.concatenate((left, [0])), window)
        of = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.flatnonzero(hit[:-1] & asked[of])
        begins = ends - sizes
        return doc[of[at]], lo[of[at]] + at - begins[of[at]], np.ones(len(at), np.int64)

    return compare


def dedup_bytes(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: each text without bytes of repeated strings.

    A byte goes if a string of `window` bytes that covers it also starts anywhere else,
    in the same document or another; matches never cross documents and are judged on the
    input.  Strings are dealt into shards by their owner (see repeats).  Runs whose
    surroundings agree need no sorting; the surroundings that differ are laid end to end
    in each shard and sorted by a suffix array.

    Null text counts as empty; a null id takes no part and keeps its bytes; rows that
    repeat an id count as separate places, and a place found in one is cut from all;
    other columns are ignored; an empty table gives no rows.
    """
    rule = Windows("byte", window, anchor, first_stays=False)
    spans = repeated_spans(docs, rule, _compare(window), id_col, text_col)

    def cut(batches):
        for batch in batches:
            total, gone, pieces, kept = [], [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode("utf-8", "replace")
                total.append(len(data))
                if places:
                    out = covered(len(data), [p["lo"] for p in places], [p["n"] for p in places], window)
                    gone.append(int(out.sum()))
                    pieces.append(int(np.count_nonzero(out[1:] & ~out[:-1]) + out[0]))
                    data = np.frombuffer(data, np.uint8)[~out].tobytes()
                else:
                    gone.append(0)
                    pieces.append(0)
                kept.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in (total, gone, pieces)], pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(spans, rows["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
