"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of segments.  A segment covers a few megabytes of whole documents and
holds, for each of its terms, the ascending list of the places where it stands; places of
neighbouring documents are one apart more than their words, so no phrase crosses a border.
A phrase is found by taking the list of its rarest term, moved back by the term's place in
the phrase, and intersecting it with the other terms' lists, the next rarest first.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.llm import arrays
from fieldwatch.llm.common import stored

#: Bytes of text in a segment, but for a longer document.
SEGMENT_BYTES = 1_500_000
#: Phrases that are searched at once; more are searched block by block.
BLOCK_PHRASES = 50_000
#: Candidate places that are held at once.
HELD = 2_000_000

#: Words are runs of ASCII digits and letters and of everything beyond ASCII; A-Z count as a-z.
BREAKS = np.ones(256, bool)
BREAKS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
VALUES = arrays.BYTES.copy()
VALUES[0x41:0x5B] = VALUES[0x61:0x7B]


def terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word of all texts in turn; words of each text.

    Words are told apart by this hash: a phrase of ten words is mistaken only where another
    word with the same hash stands in a place of the same phrase.
    """
    data, offsets = arrays.joined(texts)
    _, _, hashes, first = arrays.words(data, offsets, BREAKS, VALUES)
    return hashes, np.diff(first)


def _planes(column: np.ndarray) -> bytes:
    return np.ascontiguousarray(column.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored index: segment, ids and words (per document), terms, counts, postings.

    Every word of every text is in it.  Documents are indexed where they are read; nothing
    is shuffled.
    """
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(docs.schema[id_col].dataType)),
            T.StructField("words", T.ArrayType(T.LongType())),
            *[T.StructField(c, T.BinaryType()) for c in ("terms", "counts", "postings")],
        ]
    )

    def segment(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        hashes, words = terms(texts)
        place = np.arange(len(hashes)) + np.repeat(np.arange(len(words)), words)
        order = np.argsort(hashes, kind="stable")
        hashes = hashes[order]
        new = np.flatnonzero(np.concatenate(([True], hashes[1:] != hashes[:-1]))[: len(hashes)])
        counts = np.diff(np.concatenate((new, [len(hashes)])))
        lists = pa.ListArray.from_arrays
        columns = [
            lists(pa.array([0, len(ids)], pa.int32()), ids),
            lists(pa.array([0, len(ids)], pa.int32()), pa.array(words, pa.int64())),
            pa.array([hashes[new].astype("<u8").tobytes()], pa.binary()),
            pa.array([_planes(counts)], pa.binary()),
            pa.array([_planes(place[order])], pa.binary()),
        ]
        return pa.RecordBatch.from_arrays(columns, schema.names)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)) // SEGMENT_BYTES
            cuts = np.flatnonzero(np.diff(ends, append=-1)) + 1 if len(ends) else ()
            for a, b in zip([0, *cuts], cuts):
                yield segment(ids.slice(a, b - a), [t or b"" for t in texts.slice(a, b - a).to_pylist()])

    index = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)
    return stored(index.withColumn("segment", F.monotonically_increasing_id()), "postings")


def phrases(items: DataFrame, size: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item and terms (hashes, 8 bytes each) of every run of `size` words of every item, once.

    An item of fewer words, but not of none, is one phrase.
    """

    def run(frames):
        for frame in frames:
            for item, text in zip(frame["item"], frame["text"]):
                hashes, _ = terms([(text or "").encode()])
                size_here = min(size, len(hashes))
                if size_here:
                    rows = np.lib.stride_tricks.sliding_window_view(hashes.astype("<u8"), size_here)
                    for a in range(0, len(rows), BLOCK_PHRASES):
                        yield pd.DataFrame({"item": item, "terms": [r.tobytes() for r in rows[a : a + BLOCK_PHRASES]]})

    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInPandas(run, "item string, terms binary").distinct()


@dataclass
class Block:
    """Phrases as an array of places in `known`, the sorted hashes of all their terms."""

    known: np.ndarray
    which: np.ndarray
    size: np.ndarray
    item: np.ndarray
    names: list[str]

    @staticmethod
    def of(rows: list[tuple[str, bytes]]) -> Block:
        size = np.array([len(t) // 8 for _, t in rows], np.int64)
        flat = np.frombuffer(b"".join(t for _, t in rows), "<u8")
        known, places = np.unique(flat, return_inverse=True)
        row = np.repeat(np.arange(len(rows)), size)
        which = np.zeros((len(rows), int(size.max(initial=1))), np.int64)
        which[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = places
        names, item = np.unique(np.array([i for i, _ in rows], object), return_inverse=True)
        return Block(known, which, size, item, names.tolist())


class Segment:
    """One segment's lists, laid out for look-ups of the terms of a block of phrases."""

    def __init__(self, words, hashes: bytes, counts: bytes, postings: bytes, block: Block):
        self.begin = np.concatenate(([0], np.cumsum(np.asarray(words, np.int64) + 1)))
        hashes, counts, places = np.frombuffer(hashes, "<u8"), _unplanes(counts).astype(np.int64), _unplanes(postings)
        at = np.searchsorted(hashes, block.known)
        there = at < len(hashes)
        there[there] = hashes[at[there]] == block.known[there]
        self.rows = np.zeros(len(block.known), np.int64)  # length of each known term's list
        self.rows[there] = counts[at[there]]
        self.start = np.cumsum(self.rows) - self.rows
        ends = np.cumsum(counts)
        first = np.repeat((ends - counts)[at[there]] - self.start[there], self.rows[there])
        picked = places[first + np.arange(len(first))].astype(np.int64)
        #: All lists in one ascending array: the term's number, then the place.
        self.lists = np.repeat(np.arange(len(block.known)) << 32, self.rows) + picked

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, side="right") - 1

    def has(self, term: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Whether a term stands somewhere from `low` to `high`."""
        at = np.searchsorted(self.lists, (term << 32) + np.maximum(low, 0))
        found = at < len(self.lists)
        found[found] = self.lists[at[found]] <= (term[found] << 32) + high[found]
        return found

    def _rarest_first(self, block: Block):
        """Phrases all of whose terms are there, their terms from the rarest on, in bounded parts."""
        rows = self.rows[block.which]
        used = np.arange(block.which.shape[1]) < block.size[:, None]
        able = np.flatnonzero(((rows > 0) | ~used).all(axis=1))
        order = np.argsort(np.where(used[able], rows[able], np.iinfo(np.int64).max), axis=1, kind="stable")
        many = rows[able, order[:, 0]]
        part = np.cumsum(many) // HELD
        for k in np.unique(part):
            here = part == k
            yield able[here], order[here], many[here]

    def _anchors(self, block: Block, phrase, order, many):
        """Every place of each phrase's rarest term: row in `phrase`, place."""
        row = np.repeat(np.arange(len(phrase)), many)
        first = self.start[block.which[phrase, order[:, 0]]]
        at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(len(row))
        return row, self.lists[at] & 0xFFFFFFFF

    def exact(self, block: Block):
        """Phrase and first place of every occurrence."""
        for phrase, order, many in self._rarest_first(block):
            row, place = self._anchors(block, phrase, order, many)
            place = place - order[row, 0]
            for j in range(1, block.which.shape[1]):
                asked = np.flatnonzero(block.size[phrase[row]] > j)
                if not len(asked):
                    break
                r = row[asked]
                term, want = block.which[phrase[r], order[r, j]], place[asked] + order[r, j]
                keep = np.ones(len(row), bool)
                keep[asked] = (want >= 0) & self.has(term, want, want)
                row, place = row[keep], place[keep]
            yield phrase[row], place

    def near(self, block: Block, reach: int):
        """Phrase and place of its rarest term wherever all its terms stand within `reach` words of it."""
        for phrase, order, many in self._rarest_first(block):
            row, place = self._anchors(block, phrase, order, many)
            for j in range(1, block.which.shape[1]):
                asked = np.flatnonzero(block.size[phrase[row]] > j)
                if not len(asked):
                    break
                r, doc = row[asked], self.doc(place[asked])
                low = np.maximum(place[asked] - reach, self.begin[doc])
                high = np.minimum(place[asked] + reach, self.begin[doc + 1] - 2)
                keep = np.ones(len(row), bool)
                keep[asked] = self.has(block.which[phrase[r], order[r, j]], low, high)
                row, place = row[keep], place[keep]
            yield phrase[row], place


def _hits(segment: Segment, block: Block, reach: int | None):
    """Per document with a match: its number, hit spans, items found whole and items found near."""
    gone = np.zeros(segment.begin[-1] + 1, np.int64)
    exact, near = defaultdict(set), defaultdict(set)
    for phrase, place in segment.exact(block):
        np.add.at(gone, place, 1)
        np.add.at(gone, place + block.size[phrase], -1)
        for doc, item in np.unique(np.stack((segment.doc(place), block.item[phrase])), axis=1).T.tolist():
            exact[doc].add(block.names[item])
    for phrase, place in segment.near(block, reach) if reach is not None else ():
        for doc, item in np.unique(np.stack((segment.doc(place), block.item[phrase])), axis=1).T.tolist():
            near[doc].add(block.names[item])
    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(gone) > 0).view(np.int8), [0]))))
    spans = defaultdict(list)
    for doc, a, b in zip(segment.doc(edge[::2]).tolist(), edge[::2].tolist(), edge[1::2].tolist()):
        spans[doc].append({"a": a - int(segment.begin[doc]), "b": b - int(segment.begin[doc])})
    return [(doc, spans[doc], sorted(exact[doc]), sorted(near[doc])) for doc in sorted(exact.keys() | near.keys())]


HIT_SCHEMA = "segment long, doc_no int, spans array<struct<a:long,b:long>>, items array<string>, near array<string>"


def search(index: DataFrame, asked: DataFrame, reach: int | None = None) -> DataFrame:
    """segment, doc_no, spans, items, near: matches of all phrases, by document and block of phrases.

    spans: runs of words that belong to an occurrence, from a up to b.  near: items that
    have a phrase whose terms all stand, in any order, within `reach` words of its rarest
    one in this segment (None: not asked).  Each block holds a bounded number of phrases
    and is searched in every segment where the segment is read.
    """
    asked = stored(asked, "phrases")
    blocks = -(-asked.count() // BLOCK_PHRASES)
    parts = []
    for k in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "terms"), F.lit(blocks)) == k)
        block = Block.of([(r.item, bytes(r.terms)) for r in rows.collect()])

        def run(batches, block=block):
            for batch in batches:
                for row in batch.to_pylist():
                    hits = _hits(Segment(row["words"], row["terms"], row["counts"], row["postings"], block), block, reach)
                    if hits:
                        yield pa.RecordBatch.from_pylist(
                            [{"segment": row["segment"], "doc_no": d, "spans": s, "items": i, "near": n} for d, s, i, n in hits],
                            HIT_TYPES,
                        )

        parts.append(stored(index.select("segment", "words", "terms", "counts", "postings").mapInArrow(run, HIT_SCHEMA), "phrase-hits"))
    out = index.sparkSession.createDataFrame([], HIT_SCHEMA)
    for part in parts:
        out = out.unionByName(part)
    return out


_SPAN = pa.struct([("a", pa.int64()), ("b", pa.int64())])
HIT_TYPES = pa.schema([("segment", pa.int64()), ("doc_no", pa.int32()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string()))])


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    size: int = 10,
    reach: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items, near_items, spans.

    n_hit: words inside an occurrence of any run of `size` words of an item (an item of
    fewer words: all of them).  items: ids, as sorted strings, of the items that have such an
    occurrence in the document; near_items, for a `reach`, those that come close (see `search`).

    Nulls and corner cases: a null or empty text has no words, as document or as item; a
    null item id is written as an empty string; rows that repeat a doc_id are documents of
    their own, rows that repeat an item id are one item; no items: nothing is hit; no
    documents: no rows; other columns are ignored, whatever their names; a text of any
    length lies in one segment with all its words.
    """
    index = build_index(docs, id_col, text_col)
    found = search(index, phrases(items, size, item_col, item_text_col), reach)
    sorted_all = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    found = found.groupBy("segment", "doc_no").agg(sorted_all("spans").alias("spans"), sorted_all("items").alias("items"), sorted_all("near").alias("near_items"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    union = F.aggregate(
        "spans",
        start,
        lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(s["to"], x["a"]))).alias("n"), F.greatest(s["to"], x["b"]).alias("to")),
    )
    rows = index.select("segment", F.posexplode(F.arrays_zip("ids", "words")).alias("doc_no", "doc"))
    none = F.array().cast("array<string>")
    return rows.join(found, ["segment", "doc_no"], "left").select(
        F.col("doc.ids").alias("doc_id"),
        F.col("doc.words").alias("n_words"),
        F.coalesce(union["n"], F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        F.coalesce("near_items", none).alias("near_items"),
        "spans",
    )


SQL = r"""WITH RECURSIVE low AS (
  SELECT doc_id, row_number() OVER () AS row,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
asked AS (
  SELECT DISTINCT item, least(10, len(words)) AS size, array_to_string(list_slice(words, p, p + least(10, len(words)) - 1), ' ') AS phrase
  FROM (SELECT *, unnest(range(1, greatest(1, len(words) - 9) + 1)) AS p FROM item WHERE len(words) > 0)),
place AS (
  SELECT row, words, size, unnest(range(1, len(words) - size + 2)) AS p
  FROM low, (SELECT DISTINCT size FROM asked) WHERE len(words) >= size),
found AS (
  SELECT row, p, place.size, item FROM place JOIN asked ON asked.size = place.size AND asked.phrase = array_to_string(list_slice(words, p, p + place.size - 1), ' ')),
hit AS (SELECT row, count(DISTINCT w) AS n_hit FROM (SELECT row, unnest(range(p, p + size)) AS w FROM found) GROUP BY row),
names AS (SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT row, item FROM found) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM low LEFT JOIN hit USING (row) LEFT JOIN names USING (row)"""
