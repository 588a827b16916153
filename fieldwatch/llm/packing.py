"""Hierarchical packing of documents into training windows of several lengths."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.tokens import encoder, portions

#: Context sizes, longest first.  The shorter ones are powers of two and are never padded.
TIERS = (1024, 512, 256)
#: Tokens of one optimizer step: a step group holds so many tokens of one context size.
STEP_TOKENS = 16_384
PIECES = """doc_id long, start long, length long, ids binary, doc_tokens long,
 sequence_id long, offset long, context int, step_group long"""


class _Pool:
    """Pieces by length, with the lengths in use as bits of one integer."""

    def __init__(self):
        self.by_length, self.used = defaultdict(list), 0

    def add(self, doc, start, length):
        self.by_length[length].append((doc, start))
        self.used |= 1 << length

    def take(self, length):
        doc, start = self.by_length[length].pop()
        if not self.by_length[length]:
            self.used ^= 1 << length
        return doc, start, length

    def longest(self, most):
        """Length of the longest piece of at most so many tokens, or 0."""
        return (self.used & ((1 << (most + 1)) - 1)).bit_length() - 1 if self.used & ((1 << (most + 1)) - 1) else 0


def _fill(window, gap, pools):
    """Fill a gap from the pools in turn: whole pieces while one fits, then a cut one."""
    for pool in pools:
        while gap and (length := pool.longest(gap)):
            window.append(pool.take(length))
            gap -= length
    for pool in reversed(pools):
        if gap and pool.used:
            doc, start, length = pool.take(pool.used.bit_length() - 1)
            window.append((doc, start, gap))
            pool.add(doc, start + gap, length - gap)
            return 0
    return gap


def _powers(window):
    """Cut an incomplete window into sequences whose lengths are powers of two."""
    total, pieces = sum(p[2] for p in window), list(reversed(window))
    while total:
        want = 1 << (total.bit_length() - 1)
        total -= want
        out = []
        while want:
            doc, start, length = pieces.pop()
            part = min(length, want)
            out.append((doc, start, part))
            want -= part
            if part < length:
                pieces.append((doc, start + part, length - part))
        yield out


def pack(lengths, tiers=TIERS):
    """Sequences [(context, [(doc, start, length), ...])] that hold every token once.

    Whole longest windows are cut off first.  What is left of a document goes to the
    smallest tier it fits.  Tiers are packed from long to short: a tier's longest piece
    opens a window, and the gap takes the best fitting pieces of the shorter tiers, then
    of its own; a gap that no whole piece fits takes the front of a cut one.  Only the
    last window of all can stay incomplete, and that is cut at powers of two.
    """
    longest, pools, out = tiers[0], [_Pool() for _ in tiers], []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        for start in range(0, whole, longest):
            out.append((longest, [(doc, start, longest)]))
        if n > whole:
            tier = max(k for k, t in enumerate(tiers) if t >= n - whole)
            pools[tier].add(doc, whole, n - whole)
    for k, size in enumerate(tiers):
        while pools[k].used:
            window = [pools[k].take(pools[k].longest(size))]
            gap = _fill(window, size - window[0][2], [*pools[k + 1 :], pools[k]])
            if gap:
                out.extend((sum(p[2] for p in w), w) for w in _powers(window))
            else:
                out.append((size, window))
    return out


def _step_groups(sequences, step_tokens):
    """Group of each sequence: one context size a group, attention cost dealt back and forth."""
    groups, first = [0] * len(sequences), 0
    by_size = defaultdict(list)
    for k, (size, pieces) in enumerate(sequences):
        by_size[size].append((-sum(p[2] ** 2 for p in pieces), k))
    for size in sorted(by_size, reverse=True):
        n = max(1, -(-len(by_size[size]) * size // step_tokens))
        for place, (_, k) in enumerate(sorted(by_size[size])):
            turn, at = divmod(place, n)
            groups[k] = first + (at if turn % 2 == 0 else n - 1 - at)
        first += n
    return groups, first


def pack_documents(
    docs: DataFrame, tokenizer_path: str, tiers=TIERS, end_id: int = 0, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces of documents laid into sequences; one row per piece, with its token ids.

    Columns: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, context (padded length of the sequence), step_group.  A
    sequence is exactly `context` long, so nothing is padded.  Documents are packed
    where they are read, in portions of some megabytes of text: nothing is shuffled,
    memory is bounded by a portion and the longest document, and a task that runs again
    reads the same rows in the same order and numbers the same sequences.  Sequence and
    group ids hold the partition in their high bits.

    Null text counts as empty (one token, the end id); null ids are kept; rows that
    repeat an id are packed each on its own; other columns are ignored.
    """

    def run(batches):
        encode, task, sequences_before, groups_before = encoder(tokenizer_path), TaskContext.get().partitionId() << 36, 0, 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in portions(texts):
                ids = [x + end for x in encode.encode(texts[a:b])]
                sequences = pack([len(x) // 4 for x in ids], tiers)
                groups, made = _step_groups(sequences, step_tokens)
                rows = []
                for k, (context, pieces) in enumerate(sequences):
                    offset = 0
                    for doc, start, length in pieces:
                        flat = ids[doc]
                        rows.append(
                            (names[a + doc], start, length, flat[4 * start : 4 * (start + length)], len(flat) // 4, task + sequences_before + k, offset, context, task + groups_before + groups[k])
                        )
                        offset += length
                sequences_before, groups_before = sequences_before + len(sequences), groups_before + made
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                names_out = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "context", "step_group"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names_out)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)
