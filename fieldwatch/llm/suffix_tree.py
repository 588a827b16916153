"""Substring de-duplication by prefix-partitioned suffix trees over words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.repeats import Windows, covered, repeated_spans

WINDOW, ANCHOR = 13, 5


def tree_nodes(values: np.ndarray, depth: int) -> np.ndarray:
    """Node of each suffix at the given depth of the suffix tree, 0 .. nodes - 1 in order.

    The tree is grown in levels: suffixes that share a node share so many symbols, and a
    level of double depth splits each node by the node that follows.  Suffixes shorter
    than the depth run into the zeros past the end and get nodes of their own.
    """
    level = np.unique(values, return_inverse=True)[1].astype(np.int64) + 1
    node, done, reach, step = np.zeros(len(values), np.int64), 0, level, 1
    while True:
        if depth & step:
            ahead = np.concatenate((reach[done:], np.zeros(min(done, len(reach)), np.int64)))
            node = np.unique(node * (len(values) + 2) + ahead, return_inverse=True)[1].astype(np.int64)
            done += step
        if done == depth:
            return node
        ahead = np.concatenate((reach[step:], np.zeros(min(step, len(reach)), np.int64)))
        reach = np.unique(reach * (len(values) + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
        step *= 2


def _compare(window: int):
    def compare(contents, owner, doc, lo, asked):
        """Windows below nodes of the window's depth that hold a smaller document."""
        values = [np.frombuffer(c, "<u8") for c in contents]
        sizes = np.array([len(v) for v in values])
        begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        flat = np.zeros(int((sizes + 1).sum()), np.uint64)
        for b, v in zip(begins, values):
            flat[b : b + len(v)] = v
        counts = sizes - window + 1
        of = np.repeat(np.arange(len(values)), counts)
        within = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        node = tree_nodes(flat, window)[begins[of] + within]
        first = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, node, doc[of])
        hit = np.flatnonzero((first[node] < doc[of]) & asked[of])
        return doc[of[hit]], lo[of[hit]] + within[hit], np.ones(len(hit), np.int64)

    return compare


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, kept: each text without words that an earlier document has.

    A word goes if one of the windows of `window` words that cover it also starts in a
    document with a smaller id.  Suffixes are split into groups by a prefix of the hash
    of their owner (see repeats), as long as the size of the data asks for, so that a
    group fits in memory; in a group with differing surroundings the suffixes form a
    tree, and every node at window depth is the locus of a repeat.  Windows are judged
    on the input.

    Null text has no words; a null id takes no part and keeps its text; rows that repeat
    an id are one document: they are no repeats of each other, and a place found in one
    is cut from all; other columns are ignored; an empty table gives no rows.
    """
    rule = Windows("word", window, anchor, first_stays=True)
    spans = repeated_spans(docs, rule, _compare(window), id_col, text_col)

    def cut(batches):
        for batch in batches:
            total, gone, kept = [], [], []
            for text, places in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or "").encode("utf-8", "replace").split()
                total.append(len(words))
                if places:
                    out = covered(len(words), [p["lo"] for p in places], [p["n"] for p in places], window)
                    gone.append(int(out.sum()))
                    words = [w for w, drop in zip(words, out.tolist()) if not drop]
                else:
                    gone.append(0)
                kept.append(b" ".join(words).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined = rows.join(spans, rows["doc_id"] == spans["doc"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")
