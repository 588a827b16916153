"""Spelling variants: words of a corpus that differ by one edit from a commoner word.

Sorted-list dynamic programming.  A sorted list of words shares prefixes between
neighbours, so the rows of the edit matrix that belong to a shared prefix are computed
once for the whole range of words that have it, and a range is skipped as soon as its
prefix is more than one edit away.  Only the band of three cells around the diagonal can
hold values up to one.

Lists stay small because two words one edit apart agree before or behind the edit: of a
word cut in two halves, one half is equal.  Words meet in the list of their first half and
in that of their second half; a list that is too long is cut again inside the part that
may differ, down to a single place, where a list holds an alphabet of words at most.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.llm.common import stored

#: A run of letters; ASCII capitals are lowered before.
RUN = re.compile("[a-zÀ-ÿ]+")
#: Different words a task counts before it passes the counts on.
COUNTED_WORDS = 300_000
#: Documents whose texts are held as Python strings at once.
DOCS_HELD = 500
#: Words of a list; a longer one is cut again.
LIST_WORDS = 4_000
#: Rows (a word in a list) that a task is meant to scan.
TASK_ROWS = 60_000
#: Words of a list that are looked up at once.
LOOKED_UP = 8_192
FAR = 2


def runs_of(doc_id, text: str | None, damage: int | None) -> list[str]:
    """The runs of letters of a text, in order.

    damage: runs whose CRC-32, taken behind `<doc_id>:`, is a multiple of it lose the letter
    at that number modulo their length.
    """
    runs = RUN.findall((text or "").encode().lower().decode())  # on bytes, only A-Z are lowered
    if damage and runs:
        start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
        hashes = np.fromiter(map(zlib.crc32, "\n".join(runs).encode().split(b"\n"), repeat(start)), np.uint32, len(runs))
        for i in np.flatnonzero(hashes % damage == 0).tolist():
            k = int(hashes[i]) % len(runs[i])
            runs[i] = runs[i][:k] + runs[i][k + 1 :]
    return runs


def vocabulary(docs: DataFrame, least_length: int, least_count: int, damage: int | None, id_col: str, text_col: str) -> DataFrame:
    """word, n: words of enough letters and occurrences.  Tasks count what they read before anything is shuffled."""

    def count(batches):
        held = Counter()

        def counts():
            long = [(w, n) for w, n in held.items() if len(w) >= least_length]
            held.clear()
            columns = [pa.array([w for w, _ in long], pa.string()), pa.array([n for _, n in long], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["word", "n"])

        for batch in batches:
            for a in range(0, batch.num_rows, DOCS_HELD):
                part = batch.slice(a, DOCS_HELD)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    held.update(runs_of(doc_id, text, damage))
                    if len(held) >= COUNTED_WORDS:
                        yield counts()
        yield counts()

    rows = docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _listed(rows: DataFrame) -> DataFrame:
    """Name the list of (word, m, s, t): the m - t last and the s first letters, which its words share.

    m: letters of the list's longer words; its shorter words have one less.  The edit lies
    in the places from s up to t of the longer word.
    """
    shared = [F.substr("word", F.lit(1), F.col("s")), F.right("word", F.col("m") - F.col("t"))]
    return rows.withColumn("list", F.xxhash64("m", "s", "t", *shared))


def lists(words: DataFrame) -> DataFrame:
    """word, n, m, s, t, list: every list that a word is in, none of them long."""
    places = []
    for m in ("length(word)", "length(word) + 1"):
        m = F.expr(f"CAST({m} AS int)")
        half = F.floor(m / 2).cast("int")
        places += [F.struct(m.alias("m"), half.alias("s"), m.alias("t")), F.struct(m.alias("m"), F.lit(0).alias("s"), half.alias("t"))]
    rows = _listed(words.select("word", "n", F.explode(F.array(*places)).alias("p")).select("word", "n", "p.*"))
    done = []
    while True:
        long = rows.where("t - s > 1").groupBy("list").agg(F.count(F.lit(1)).alias("words")).where(F.col("words") > LIST_WORDS)
        long = stored(long.select("list"), "long-lists")
        if long.isEmpty():
            break
        done.append(rows.join(long, "list", "left_anti").select(*rows.columns))
        middle = F.col("s") + F.floor((F.col("t") - F.col("s")) / 2).cast("int")
        cut = F.array(F.struct(middle.alias("s"), "t"), F.struct("s", middle.alias("t")))
        rows = _listed(rows.join(long, "list", "left_semi").select("word", "n", "m", F.explode(cut).alias("p")).select("word", "n", "m", "p.*"))
    for part in done:
        rows = rows.unionByName(part)
    return rows


def _sorted_list(letters, length, m, s, t):
    """Order of the rows by (shared letters, letters in question), and these in that order."""
    n, short = len(letters), length < m
    key = np.zeros((n, m), np.uint8)
    key[:, :s] = letters[:, :s]
    key[:, s : s + m - t] = np.where(short[:, None], letters[:, max(t - 1, 0) : m - 1] if t else letters[:, :m], letters[:, t:m])
    rest = letters[:, s:t].copy()
    rest[short, t - s - 1] = 0
    key[:, s + m - t :] = rest
    order = np.argsort(np.ascontiguousarray(key).view(f"S{m}").ravel(), kind="stable")
    return order, key[order], s + m - t


def near_in_list(letters: np.ndarray, length: np.ndarray, m: int, s: int, t: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows one edit apart, the edit's first possible place being in [s, t).

    letters: one row per word, one byte per letter, zero behind the end; the rows may belong
    to several lists with the same m, s and t.
    """
    order, key, fixed = _sorted_list(letters, length, m, s, t)
    long, depth = (length == m)[order], t - s
    shared = np.concatenate(([0], (key[1:] != key[:-1]).argmax(axis=1)))  # letters in common with the row before
    starts = [np.append(np.flatnonzero(shared < fixed + d), len(key)) for d in range(depth + 1)]
    starts[0][0] = 0
    first, second = [], []
    group = np.searchsorted(starts[0], np.arange(len(key)), side="right") - 1
    alone = np.diff(starts[0])[group] == 1
    asking = np.flatnonzero(~alone)
    for a in range(0, len(asking), LOOKED_UP):
        q = asking[a : a + LOOKED_UP]
        node = group[q]
        # Cells (d, d - 1), (d, d) and (d, d + 1) of the matrix of a range's prefix and the word.
        left, mid, right = np.full(len(q), FAR, np.int8), np.zeros(len(q), np.int8), np.ones(len(q), np.int8)
        for d in range(depth):
            child = np.searchsorted(starts[d + 1], starts[d][node])
            many = np.searchsorted(starts[d + 1], starts[d][node + 1]) - child
            row = np.repeat(np.arange(len(q)), many)
            child = np.repeat(child - (np.cumsum(many) - many), many) + np.arange(len(row))
            later = starts[d + 1][child + 1] - 1 > q[row]  # each pair is found from its first word
            row, child = row[later], child[later]
            q, left, mid, right = q[row], left[row], mid[row], right[row]
            letter = key[starts[d + 1][child], fixed + d]
            differs = [letter != key[q, fixed + j] if 0 <= j < depth else np.True_ for j in (d - 1, d, d + 1)]
            if d == depth - 1:  # shorter words end here, before their padding
                ends = (letter == 0) & long[q] & (right == 1)
                first.append(q[ends])
                second.append(starts[d + 1][child[ends]])
            left = np.minimum(left + differs[0], mid + 1).astype(np.int8)
            mid = np.minimum(np.minimum(mid + differs[1], right + 1), left + 1).astype(np.int8)
            right = np.minimum(right + differs[2], mid + 1).astype(np.int8)
            keep = (np.minimum(np.minimum(left, mid), right) < FAR) & (letter != 0)
            q, left, mid, right, node = q[keep], left[keep], mid[keep], right[keep], child[keep]
        ends = np.where(long[q], mid, left) == 1
        first.append(q[ends])
        second.append(starts[depth][node[ends]])
    a, b = order[np.concatenate(first)] if first else order[:0], order[np.concatenate(second)] if second else order[:0]
    # Where a letter is added to a run of the same letter, the first place counts.
    here = (length[a] == length[b]) | (letters[a, :t] != letters[b, :t]).any(axis=1)
    return a[here], b[here]


def _best(words: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """Of pairs both ways: how many partners each word has, and the commonest, then first, of them."""
    x, y = np.concatenate((a, b)), np.concatenate((b, a))
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    head = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))[: len(x)])
    many = np.diff(np.append(head, len(x)))
    text = [w.decode("latin-1") for w in words[x[head]]], [w.decode("latin-1") for w in words[y[head]]]
    return pd.DataFrame({"word": text[0], "near": many, "other": text[1], "other_n": n[y[head]]})


def scan(frame: pd.DataFrame) -> pd.DataFrame:
    """Partners of the words of all lists of a task: word, near, other, other_n."""
    out = [pd.DataFrame({"word": [], "near": [], "other": [], "other_n": []}).astype({"word": str, "near": np.int64, "other": str, "other_n": np.int64})]
    for (m, s, t), part in frame.groupby(["m", "s", "t"]):
        words = np.array([w.encode("latin-1") for w in part["word"]], f"S{m}")
        letters = words.view(np.uint8).reshape(len(words), m)
        a, b = near_in_list(letters, np.char.str_len(words), int(m), int(s), int(t))
        if len(a):
            out.append(_best(words, part["n"].to_numpy(), a, b))
    return pd.concat(out, ignore_index=True)


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the last of a word's chain of forms, by doubling what is known of the chain.

    A form is at least twice as common as its word, so chains are short and never close.
    """
    state = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = state.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        state = stored(state.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if state.where("moved").isEmpty():
            return state.select("word", "root")
        state = state.drop("moved")


def variants(
    docs: DataFrame,
    least_length: int = 5,
    least_count: int = 3,
    ratio: int = 2,
    damage: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per word of the corpus: word, form, root, n, n_near, form_n.

    n: occurrences; n_near: words one inserted, deleted or replaced letter away; form: the
    commonest of them (ties: first in code point order) if it is at least `ratio` times as
    common, else null, with its count form_n; root: the last word of the chain of forms.
    `damage` misspells some runs before they are counted (see `runs_of`).

    Nulls and corner cases: a null or empty text has no words; a null id is an empty string
    where `damage` needs it; rows that repeat an id count again; an empty table gives no
    rows; other columns are ignored, whatever their names; texts and words of any length
    are read whole.
    """
    words = stored(vocabulary(docs, least_length, least_count, damage, id_col, text_col), "vocabulary")
    rows = lists(words)
    tasks = max(1, -(-4 * words.count() // TASK_ROWS))
    rows = rows.select("word", "n", "m", "s", "t", F.pmod("list", F.lit(tasks)).alias("task"))
    found = rows.groupBy("task").applyInPandas(scan, "word string, near long, other string, other_n long")
    best = F.min_by(F.struct("other", "other_n"), F.struct(-F.col("other_n"), "other"))
    found = found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("best"))
    commoner = F.col("best.other_n") >= ratio * F.col("n")
    known = words.join(found, "word", "left").select(
        "word",
        "n",
        F.coalesce("near", F.lit(0)).alias("n_near"),
        F.when(commoner, F.col("best.other")).alias("form"),
        F.when(commoner, F.col("best.other_n")).alias("form_n"),
    )
    known = stored(known, "forms")
    roots = _roots(known.where("form IS NOT NULL"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _crc_step(crc: str, byte: str) -> str:
    """One byte of CRC-32 in SQL: its eight steps add a constant for each low bit that is set."""
    mixed = f"xor({crc}, {byte})"
    out = f"({mixed} >> 8)"
    for bit in range(8):
        value = 1 << bit
        for _ in range(8):
            value = (value >> 1) ^ (0xEDB88320 if value & 1 else 0)
        out = f"xor({out}, (({mixed} >> {bit}) & 1) * {value})"
    return out


#: The same on DuckDB for `documents`, with a damage of 97.
SQL = rf"""WITH RECURSIVE run AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL),
fed AS (SELECT doc_id, run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM run),
crc(doc_id, run, n, bytes, i, c) AS (
  SELECT doc_id, run, n, bytes, 0, CAST(4294967295 AS BIGINT) FROM fed
  UNION ALL
  SELECT doc_id, run, n, bytes, i + 1, {_crc_step("c", "CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)")} FROM crc WHERE 2 * i < length(bytes)),
hashed AS (SELECT run, n, xor(c, 4294967295) AS h, xor(c, 4294967295) % length(run) AS k FROM crc WHERE 2 * i = length(bytes)),
word AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, k) || substr(run, k + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM word)),
pair AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN word b ON a.rest = b.word),
best AS (SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) AS r FROM pair),
form AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM word w LEFT JOIN best b ON b.word = w.word AND r = 1),
chain(word, root) AS (
  SELECT word, word FROM form
  UNION ALL
  SELECT chain.word, form.form FROM chain JOIN form ON form.word = chain.root WHERE form.form IS NOT NULL)
SELECT form.word, form.form, chain.root, form.n, form.n_near, form.form_n
FROM form JOIN chain ON chain.word = form.word JOIN form last ON last.word = chain.root AND last.form IS NULL"""
