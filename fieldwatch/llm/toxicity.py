"""Toxicity of texts by a small convolutional classifier, trained and applied in numpy inside tasks.

Counts, models and thresholds come from every labelled row outside fold 0.  Rows are dealt
into shards by a hash of their id; in each epoch every shard trains from the common
parameters, and the parameters (weighted by rows) are averaged.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldwatch.llm import arrays
from fieldwatch.llm.common import likely_in, stored
from fieldwatch.session import row_sized

#: Bytes of the word beginnings that have buckets of their own.
STEMS = (6, 7)
#: Labelled rows of a shard, about.  All rows are used; a shard is what one task trains on at once.
SHARD_ROWS = 8_192
HASH_BITS, EMBEDDING, WIDTHS, FILTERS, MOST_BUCKETS, LEAST_EVIDENCE = 18, 8, (1, 2, 3), 8, 2048, 2.0
EPOCHS, RATE, DECAY, SEED = 12, 0.01, 1e-4, 5
#: Parts of a task's counts of buckets, each added up by itself.
COUNT_SLICES = 256
#: Steps of a logit that calibration tells apart.
CUT_STEPS = 1_000
#: Positive rows of a language from which on its own threshold replaces the common one.
LEAST_POSITIVES = 20

#: ASCII letters in lower case; white space and ASCII punctuation part words.
_FOLD = arrays.BYTES.copy()
_FOLD[65:91] = arrays.BYTES[97:123]
_BREAKS = arrays.SPACE.copy()
_BREAKS[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in "'*@$"]] = True


@dataclass
class Model:
    """Buckets in use (0 for the others), embeddings, filters by width, output weights."""

    index: np.ndarray
    embedding: np.ndarray
    filters: list = field(default_factory=list)
    weights: np.ndarray = None
    bias: float = 0.0
    thresholds: dict = field(default_factory=dict)


def hashed_words(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of each word of all texts in turn, and where each text begins.

    A word has one bucket for itself and one for each of its beginnings in STEMS bytes,
    so that forms not seen in training still show their stem.
    """
    data, offsets = arrays.joined([(t or "").encode("utf-8", "replace") for t in texts])
    starts, ends, hashes, first = arrays.words(data, offsets, _BREAKS, _FOLD)
    sums = arrays.prefix_sums(_FOLD[data])
    kinds = [hashes, *[arrays.window_hashes(sums, starts, np.minimum(starts + k, ends)) + np.uint64(k * int(arrays.BASE) % 2**64) for k in STEMS]]
    return np.stack([(h >> np.uint64(64 - HASH_BITS)).astype(np.int32) for h in kinds], axis=1), first


def _windows(words: np.ndarray, first: np.ndarray):
    """Windows of three words that hold a word in use, as rows of ids, and their text.

    Texts are padded with the empty word 0, so each also has a window of nothing; the
    pooling below starts from that one and skips all windows like it.
    """
    n, longest = len(first) - 1, max(WIDTHS)
    padded = np.zeros((len(words) + n * (longest - 1), words.shape[1]), np.int32)
    text_of = np.repeat(np.arange(n), np.diff(first))
    at = np.arange(len(words)) + text_of * (longest - 1)
    padded[at] = words
    owner = np.zeros(len(padded), np.int64)
    lengths = np.diff(first) + longest - 1
    owner[:] = np.repeat(np.arange(n), lengths)
    begin = np.concatenate(([0], np.cumsum(lengths)))
    used = np.flatnonzero(padded.any(axis=1))
    starts = np.unique(np.concatenate([used - j for j in range(longest)])) if len(used) else used
    starts = starts[starts >= 0]
    near = np.minimum(starts[:, None] + np.arange(longest), max(len(padded) - 1, 0))
    text = owner[near[:, -1]] if len(starts) else starts
    if not len(starts):
        return np.zeros((0, longest, words.shape[1]), np.int32), starts
    rows = np.where((near >= begin[text][:, None])[:, :, None], padded[near], 0)
    return rows, text


def _windows_of_places(text, at, ids):
    """As `_windows`, from the words in use alone: their text, place and ids, in order."""
    longest = max(WIDTHS)
    stride = int(at.max(initial=0)) + 2 * longest
    places = text * stride + at + longest
    around = np.zeros((len(places), 2 * longest - 1, ids.shape[1]), ids.dtype)
    around[:, longest - 1] = ids
    for k in range(1, longest):
        for j in range(1, k + 1):
            follows = np.flatnonzero(places[j:] == places[: len(places) - j] + k)
            around[follows, longest - 1 + k] = ids[follows + j]
    new = np.minimum(np.diff(places, prepend=-longest), longest)
    word = np.repeat(np.arange(len(places)), new)
    before = np.repeat(np.cumsum(new), new) - 1 - np.arange(len(word))
    return around[word[:, None], longest - 1 - before[:, None] + np.arange(longest)], text[word]


def _numbered(ids: np.ndarray):
    """The distinct words in use, a row of ids each after one of zeros, and the number of each word's row there."""
    base = np.int64(1 << 20)
    keys = (ids[:, 0].astype(np.int64) * base + ids[:, 1]) * base + ids[:, 2]
    used = np.flatnonzero(keys)
    found, at = np.unique(keys[used], return_inverse=True)
    kinds = np.zeros((len(found) + 1, 3), np.int32)
    kinds[1:] = np.stack([found // base // base, found // base % base, found % base], axis=1)
    numbers = np.zeros(len(ids), np.int32)
    numbers[used] = at + 1
    return kinds, numbers


def _kernel(filters) -> list[np.ndarray]:
    """By place in a window, the weights of all filters that reach it, side by side; wider filters are last."""
    return [np.concatenate([a[j] for a, _ in filters if len(a) > j], axis=1) for j in range(len(filters[-1][0]))]


def _strongest(filters, x: np.ndarray, rows: np.ndarray, text: np.ndarray, n: int):
    """Of each text and filter the largest response, not below that of no words, and the window that gives it (-1: none).

    x: embeddings of the distinct words; rows: their numbers by window, windows in order of their text.
    """
    bias = np.concatenate([b for _, b in filters])
    best, at = np.tile(np.maximum(bias, 0), (n, 1)), np.full((n, len(bias)), -1)
    if not len(text):
        return best, at
    parts = [x @ a for a in _kernel(filters)]
    z = parts[0].take(rows[:, 0].astype(np.intp), axis=0)
    for j in range(1, len(parts)):
        z[:, -parts[j].shape[1] :] += parts[j].take(rows[:, j].astype(np.intp), axis=0)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(text)) + 1, [len(text)]))
    own = text[edges[:-1]]
    first = np.array([a + z[a:b].argmax(axis=0) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())])
    value = z[first, np.arange(len(bias))] + bias
    up = (value >= best[own]) & (value > 0)
    best[own], at[own] = np.where(up, value, best[own]), np.where(up, first, -1)
    return best, at


def _embedded(embedding: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    return sum(embedding[kinds[:, k]] for k in range(kinds.shape[1]))


def _logits(model: Model, kinds, rows, text, n) -> np.ndarray:
    return _strongest(model.filters, _embedded(model.embedding, kinds), rows, text, n)[0] @ model.weights + model.bias


def logits(model: Model, rows, text, n) -> np.ndarray:
    kinds, numbers = _numbered(rows.reshape(-1, rows.shape[2]))
    return _logits(model, kinds, numbers.reshape(rows.shape[:2]), text, n)


def _portions(first, most_words: int = 200_000):
    """Ranges of texts with about so many words; keeps what training holds at once small."""
    start = 0
    for k in range(len(first) - 1):
        if first[k + 1] - first[start] >= most_words or k == len(first) - 2:
            yield start, k + 1
            start = k + 1


def _all_windows(index, words, first):
    """Windows of many texts, portion by portion."""
    found = [(rows, text + a) for a, b in _portions(first) for rows, text in [_windows(index[words[first[a] : first[b]]], first[a : b + 1] - first[a])]]
    if not found:
        return _windows(index[words], first)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _seen(words, first) -> list[np.ndarray]:
    """The distinct buckets of each text, ascending."""
    return [np.unique(words[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def _times(seen: list[np.ndarray]) -> np.ndarray:
    """In how many texts each bucket occurs."""
    return np.bincount(np.concatenate([np.zeros(0, np.int32), *seen]), minlength=1 << HASH_BITS)


def _bucket_counts(words, first, labels):
    """In how many toxic and how many other texts each bucket occurs."""
    seen = _seen(words, first)
    return _times([x for x, y in zip(seen, labels) if y == 1]), _times([x for x, y in zip(seen, labels) if y == 0])


def start(hit, miss, positive: int, negative: int, seed: int = SEED) -> Model:
    """The model before training, from the counts of all its rows.

    Buckets seen in one text only or without evidence for a class, and all but the
    MOST_BUCKETS with most evidence, share the fixed empty embedding.  Embeddings start from
    the words' smoothed log-odds between toxic and other texts plus noise.  Rows of one class
    alone give a constant score.
    """
    draw = np.random.default_rng(seed)
    odds = np.log((hit + 0.5) / (max(1, positive) + 1)) - np.log((miss + 0.5) / (max(1, negative) + 1))
    evidence = odds / np.sqrt(1 / (hit + 0.5) + 1 / (miss + 0.5))
    use = np.flatnonzero((hit + miss >= 2) & (np.abs(evidence) >= LEAST_EVIDENCE))
    use = use[np.argsort(-np.abs(evidence[use]), kind="stable")][:MOST_BUCKETS]
    index = np.zeros(1 << HASH_BITS, np.int32)
    index[use] = np.arange(1, len(use) + 1)
    embedding = draw.normal(0, 0.05, (len(use) + 1, EMBEDDING))
    embedding[1:, 0] = np.clip(odds[use], -4, 4) * 0.5
    embedding[0] = 0
    filters = []
    for width in WIDTHS:
        a = draw.normal(0, 0.2, (width, EMBEDDING, FILTERS))
        a[:, 0] = np.abs(a[:, 0]) + 0.3 / width
        filters.append((a, np.full(FILTERS, -0.2)))
    weights = np.abs(draw.normal(0.3, 0.1, FILTERS * len(WIDTHS)))
    share = min(max(positive / max(1, positive + negative), 1e-3), 1 - 1e-3)
    if not (positive and negative):
        weights = np.zeros_like(weights)
    return Model(index, embedding, filters, weights, float(np.log(share / (1 - share))))


@dataclass
class State:
    """Parameters in training (embedding, output weights, filters, bias), Adam's two moments and its steps."""

    params: list
    first: list
    second: list
    step: int = 0

    @staticmethod
    def of(model: Model) -> State:
        params = [model.embedding, model.weights, *[p for f in model.filters for p in f], np.array([model.bias])]
        return State([p.copy() for p in params], [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params])

    def model(self, index: np.ndarray) -> Model:
        embedding, weights, *filters, bias = self.params
        return Model(index, embedding, list(zip(filters[::2], filters[1::2])), weights, float(bias[0]))

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for kind in (self.params, self.first, self.second) for p in kind])

    def filled(self, flat: np.ndarray, step: int) -> State:
        """The state of this shape with the numbers of `flat`."""
        shapes = [p.shape for p in self.params] * 3
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        parts = [part.reshape(s).copy() for part, s in zip(np.split(flat, ends[:-1]), shapes)]
        n = len(self.params)
        return State(parts[:n], parts[n : 2 * n], parts[2 * n :], step)


def train_epoch(state: State, kinds, rows, text, labels, draw, rate: float = RATE, decay: float = DECAY) -> None:
    """One pass over the texts' windows by Adam on the logistic loss; changes `state`.

    kinds: the distinct words, by the ids of their buckets; rows: their numbers by window.
    """
    cuts, batch = np.searchsorted(text, np.arange(len(labels) + 1)), max(16, min(256, len(labels) // 16))
    for some in np.array_split(draw.permutation(len(labels)), max(1, len(labels) // batch)):
        some = np.sort(some)
        take = np.concatenate([np.arange(cuts[d], cuts[d + 1]) for d in some])
        own, of = rows[take], np.repeat(np.arange(len(some)), cuts[some + 1] - cuts[some])
        model = state.model(None)
        x = _embedded(model.embedding, kinds)
        pooled, best = _strongest(model.filters, x, own, of, len(some))
        error = (1 / (1 + np.exp(-np.clip(pooled @ model.weights + model.bias, -30, 30))) - labels[some]) / len(some)
        grads = [np.zeros_like(p) for p in state.params]
        grads[1] = pooled.T @ error
        grads[-1][0] = error.sum()
        texts, columns = np.nonzero(best >= 0)
        push, window = error[texts] * model.weights[columns], own[best[texts, columns]]
        biases = np.bincount(columns, push, pooled.shape[1])
        for f in range(len(WIDTHS)):
            grads[3 + 2 * f] += biases[f * FILTERS : (f + 1) * FILTERS]
        for j, a in enumerate(_kernel(model.filters)):
            lead = pooled.shape[1] - a.shape[1]
            reach = columns >= lead
            words, at = np.unique(window[reach, j], return_inverse=True)
            pushed = np.bincount(at * a.shape[1] + columns[reach] - lead, push[reach], len(words) * a.shape[1]).reshape(-1, a.shape[1])
            np.add.at(grads[0], kinds[words], (pushed @ a.T)[:, None, :])
            slope = x[words].T @ pushed
            for k, f in enumerate(range(lead // FILTERS, len(WIDTHS))):
                grads[2 + 2 * f][j] += slope[:, k * FILTERS : (k + 1) * FILTERS]
        grads[0][0] = 0
        state.step += 1
        for k, (p, g, m, v) in enumerate(zip(state.params, grads, state.first, state.second)):
            if k < len(grads) - 1:
                g = g + decay * p
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**state.step)) / (np.sqrt(v / (1 - 0.999**state.step)) + 1e-8)
        state.params[0][0] = 0


def train(words, first, labels, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model of rows held in memory: the start of their counts, then `epochs` passes as one shard makes them."""
    labels = np.asarray(labels, np.int64)
    positive, negative = int((labels == 1).sum()), int((labels == 0).sum())
    model = start(*_bucket_counts(words, first, labels), positive, negative, seed)
    if not (positive and negative):
        return model
    rows, text = _all_windows(model.index, words, first)
    kinds, numbers = _numbered(rows.reshape(-1, rows.shape[2]))
    state = State.of(model)
    for epoch in range(epochs):
        train_epoch(state, kinds, numbers.reshape(rows.shape[:2]), text, labels, np.random.default_rng([seed, epoch, 0]))
    return state.model(model.index)


def _best_cut(values, hits, counts) -> float:
    """The cut with the best F1, midway between the values around it.  Each value has counts, hits of them toxic."""
    order = np.argsort(-values, kind="stable")
    v, found = values[order], np.cumsum(hits[order])
    k = int(np.argmax(2 * found / (np.cumsum(counts[order]) + max(1, hits.sum()))))
    return float((v[k] + v[k + 1]) / 2 if k + 1 < len(v) else v[k] - 1)


def known_labels(labels: DataFrame, id_col: str) -> DataFrame:
    """id, toxic and part (0 to 3) of every labelled id outside fold 0."""
    known = labels.where(F.col("toxic").isNotNull() & F.col(id_col).isNotNull()).groupBy(id_col).agg(F.max("toxic").cast("long").alias("toxic"))
    return known.select(F.col(id_col).cast("long").alias("id"), "toxic", (_fold(id_col) - 1).cast("long").alias("part")).where(F.col("part") >= 0)


def _fold(id_col: str):
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5


def _labelled(rows: DataFrame, known: DataFrame) -> DataFrame:
    return rows.join(row_sized(known), "id")


def _squeezed(values: np.ndarray) -> bytes:
    """Integers of one width as compressed bytes, all first bytes, then all second ones."""
    return zlib.compress(values.reshape(-1, 1).view(np.uint8).T.tobytes(), 1)


def _spread(data: bytes, kind) -> np.ndarray:
    """The integers of `_squeezed`, of the given type."""
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _steps(values: np.ndarray) -> bytes:
    """Ascending integers by what each adds to the one before."""
    return _squeezed(np.diff(values, prepend=0).astype(np.int32))


def _sum_up(data: bytes) -> np.ndarray:
    return np.cumsum(_spread(data, np.int32), dtype=np.int32)


def seen_buckets(docs: DataFrame) -> DataFrame:
    """The rows with the distinct buckets of their text (`seen`) in place of it."""

    def run(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.iloc[k : k + 256]
                yield some.drop(columns="text").assign(seen=[_steps(x) for x in _seen(*hashed_words(some["text"].tolist()))])

    return docs.mapInPandas(run, T.StructType([f for f in docs.schema if f.name != "text"]).add("seen", "binary"))


def count_buckets(rows: DataFrame) -> np.ndarray:
    """Counts over all rows (text, toxic, part): [calibrating or not, toxic or not, bucket]; the last bucket counts rows."""
    return count_seen(seen_buckets(rows.select("text", "toxic", "part")))


def count_seen(rows: DataFrame) -> np.ndarray:
    """As `count_buckets`, of rows (seen, toxic, part)."""
    size = 1 << HASH_BITS

    def counted(batches):
        total = np.zeros((2, 2, size + 1), np.int64)
        for batch in batches:
            for k in range(0, len(batch), 1024):
                some = batch.iloc[k : k + 1024]
                toxic, held = some["toxic"].to_numpy(np.int64), some["part"].to_numpy() == 0
                for own, which in enumerate((held, ~held)):
                    for label in (0, 1):
                        mine = some["seen"][which & (toxic == label)]
                        if len(mine):
                            total[own, label, :size] += _times([_sum_up(x) for x in mine])
                            total[own, label, size] += len(mine)
        if total.any():
            parts = np.array_split(total.ravel(), COUNT_SLICES)
            yield pd.DataFrame({"slice": np.arange(len(parts)), "n": [p.tobytes() for p in parts]})

    def added(pdf):
        return pd.DataFrame({"slice": [pdf["slice"].iloc[0]], "n": [sum(np.frombuffer(x, np.int64) for x in pdf["n"]).tobytes()]})

    found = rows.select("seen", "toxic", "part").mapInPandas(counted, "slice int, n binary")
    sums = found.groupBy("slice").applyInPandas(added, "slice int, n binary").toArrow().to_pandas().sort_values("slice")
    total = np.frombuffer(b"".join(sums["n"]), np.int64) if len(sums) else np.zeros(4 * (size + 1), np.int64)
    return total.reshape(2, 2, size + 1)


#: A text's words in use for any model: their places and the slots of their buckets, compressed.
_USED = "at binary, slots binary"


def used_words(docs: DataFrame, slot: np.ndarray) -> DataFrame:
    """The words in use of each text (id, lang, text), see _USED; slot: of each bucket, 0 if not in use."""

    def used(batches):
        for batch in batches:
            for k in range(0, len(batch), 256):
                some = batch.iloc[k : k + 256]
                words, first = hashed_words(some["text"].tolist())
                ids = slot[words]
                at = np.flatnonzero(ids.any(axis=1))
                ends, ids = np.searchsorted(at, first), ids[at]
                places = [_steps(at[a:b] - f) for a, b, f in zip(ends, ends[1:], first)]
                yield some.drop(columns="text").assign(at=places, slots=[_squeezed(ids[a:b]) for a, b in zip(ends, ends[1:])])

    return docs.mapInPandas(used, f"id long, lang string, {_USED}")


_SHARD = "shard long, n long, toxic binary, part binary, lang array<string>, places binary, at binary, words binary, kinds binary"


def _packed(used: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
    """The labelled rows of a shard, by id, as one row of arrays: words by the number of their kind, kinds by slots."""
    fields = [f.split()[0] for f in _SHARD.split(", ")]
    pdf = used.drop(columns="shard").merge(known, on="id")
    if not len(pdf):
        return pd.DataFrame(columns=fields)
    pdf["at"] = [_sum_up(x).tobytes() for x in pdf["at"]]
    pdf["slots"] = [_spread(x, np.int16).tobytes() for x in pdf["slots"]]
    pdf = pdf.sort_values(["id", "at", "slots", "toxic", "lang"], ignore_index=True)
    row = {"shard": pdf["shard"].iloc[0], "n": len(pdf), "lang": pdf["lang"].fillna("").tolist()}
    for c in ("toxic", "part"):
        row[c] = pdf[c].to_numpy(np.int64).tobytes()
    row["places"] = (pdf["at"].map(len).to_numpy(np.int64) // 4).tobytes()
    kinds, words = _numbered(np.frombuffer(b"".join(pdf["slots"]), np.int16).reshape(-1, 1 + len(STEMS)))
    row |= {"at": b"".join(pdf["at"]), "words": words.tobytes(), "kinds": kinds.tobytes()}
    return pd.DataFrame([row])[fields]


def shard_rows(used: DataFrame, known: DataFrame, n: int) -> DataFrame:
    """All n labelled rows (id, lang and used words; id, toxic, part) as stored shards, a row each.
    Which rows meet in a shard, and their order, follow from their ids."""
    shards = max(1, round(n / SHARD_ROWS))
    used, known = (x.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards))).repartition(shards, "shard").groupBy("shard") for x in (used, known))
    return stored(used.cogroup(known).applyInPandas(_packed, _SHARD), "toxicity-shards", maxRecordsPerFile=1, compression="zstd")


def _unpacked(row, index: np.ndarray, chosen: np.ndarray):
    """Kinds of words, windows of them, their text and labels of the chosen rows of a shard; index: the model's number of each slot."""
    toxic, places = np.frombuffer(row.toxic, np.int64), np.frombuffer(row.places, np.int64)
    at, words = np.frombuffer(row.at, np.int32), np.frombuffer(row.words, np.int32)
    kinds = index[np.frombuffer(row.kinds, np.int32).reshape(-1, 1 + len(STEMS))]
    number = np.full(len(toxic), -1)
    number[chosen] = np.arange(len(chosen))
    owner = np.repeat(number, places)
    kept = (owner >= 0) & kinds.any(axis=1)[words]
    windows, text = _windows_of_places(owner[kept], at[kept], words[kept, None])
    return kinds, windows[:, :, 0], text, toxic[chosen]


def _chosen(row, m: int) -> np.ndarray:
    """Rows of a shard that train model m: 0 leaves part 0 out."""
    part = np.frombuffer(row.part, np.int64)
    return np.flatnonzero(part != 0) if m == 0 else np.arange(len(part))


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    """Sums of the states of some shards, in the order of their numbers."""
    pdf = pdf.sort_values("shard")
    total = sum(np.frombuffer(x) for x in pdf["state"])
    return pd.DataFrame({"model": [pdf["model"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "rows": [pdf["rows"].sum()], "step": [pdf["step"].max()], "state": [total.tobytes()]})


def average_epoch(shards: DataFrame, states: dict[int, State], epoch: int, indexes: list[np.ndarray], seed: int = SEED) -> dict[int, State]:
    """The states after every shard trained one epoch from the given ones: averages, weighted by rows.

    Groups of shards are added first; the driver gets one state a group, of a size that the
    model fixes, and of groups about the square root of the number of shards.
    """
    schema = "model int, shard long, rows long, step long, state binary"

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                for m, state in states.items():
                    kinds, windows, text, toxic = _unpacked(row, indexes[m], _chosen(row, m))
                    if not len(toxic):
                        continue
                    own = state.filled(state.flat(), state.step)
                    train_epoch(own, kinds, windows, text, toxic, np.random.default_rng([seed, epoch, row.shard]))
                    yield pd.DataFrame({"model": [m], "shard": [row.shard], "rows": [len(toxic)], "step": [own.step], "state": [(own.flat() * len(toxic)).tobytes()]})

    n = shards.count()
    trained = shards.mapInPandas(run, schema)
    group = F.pmod("shard", F.lit(int(np.ceil(np.sqrt(max(1, n))))))
    sums = trained.groupBy("model", group.alias("group")).applyInPandas(_sums, schema).toArrow().to_pandas()
    out = {}
    for m, mine in sums.groupby("model"):
        total = _sums(mine).iloc[0]
        out[m] = states[m].filled(np.frombuffer(total["state"]) / total["rows"], int(total["step"]))
    return out


def calibrate(shards: DataFrame, trial: Model, index: np.ndarray) -> tuple[float, dict]:
    """The common cut and, less it, those of languages with enough toxic rows, from all rows of part 0."""

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                held = np.flatnonzero(np.frombuffer(row.part, np.int64) == 0)
                kinds, windows, text, toxic = _unpacked(row, index, held)
                value = _logits(trial, kinds, windows, text, len(held))
                lang = np.asarray(row.lang, dtype=object)[held]
                yield pd.DataFrame({"lang": lang, "value": np.rint(value * CUT_STEPS).astype(np.int64), "toxic": toxic})

    def best(pdf):
        hits = pdf["hits"].to_numpy()
        value = _best_cut(pdf["value"].to_numpy() / CUT_STEPS, hits, pdf["n"].to_numpy())
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "cut": [value], "hits": [hits.sum()]})

    scored = shards.mapInPandas(run, "lang string, value long, toxic long")
    counted = scored.groupBy("lang", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("hits"))
    whole = counted.groupBy("value").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    common = whole.withColumn("lang", F.lit("")).groupBy("lang").applyInPandas(best, "lang string, cut double, hits long").first()
    each = counted.groupBy("lang").applyInPandas(best, "lang string, cut double, hits long").where(F.col("hits") >= LEAST_POSITIVES)
    return common.cut, {r.lang: r.cut - common.cut for r in sorted(each.collect())}


def fit_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """The model of all labelled rows outside fold 0.  Part 0 of them calibrates, the others train.

    A first model, trained without part 0, is cut on part 0: the common cut becomes the
    score 0.5 and each language with enough toxic rows there gets a cut of its own.  The
    model used is trained on all parts and keeps those cuts.  The driver holds counts by
    bucket and the models, both of fixed size.
    """
    rows = docs.where(_fold(id_col) != 0).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known, size = known_labels(labels, id_col), 1 << HASH_BITS
    rows = likely_in(rows, F.col("id"), known, F.col("id"))
    held, others = count_seen(_labelled(seen_buckets(rows.drop("lang")), known))
    everything = held + others
    begun = [start(c[1, :size], c[0, :size], int(c[1, size]), int(c[0, size])) for c in (others, everything)]
    if not everything[:, size].all():
        return begun[1]
    cutting = held[1, size] >= 3 and others[:, size].all()
    used = np.flatnonzero(begun[0].index | begun[1].index)
    slot = np.zeros(size, np.int16)
    slot[used] = np.arange(1, len(used) + 1)
    indexes = [np.concatenate(([0], m.index[used])).astype(np.int32) for m in begun]
    shards = shard_rows(used_words(rows, slot), known, int(everything[:, size].sum()))
    states = {m: State.of(begun[m]) for m in ((0, 1) if cutting else (1,))}
    for epoch in range(EPOCHS):
        states = average_epoch(shards, states, epoch, indexes)
    model = states[1].model(begun[1].index)
    common, own = calibrate(shards, states[0].model(begun[0].index), indexes[0]) if cutting else (0.0, {})
    model.bias -= common
    model.thresholds = {k: float(1 / (1 + np.exp(-v))) for k, v in own.items()}
    return model


def _compact(model: Model) -> Model:
    """The model in single precision, as it travels to the workers."""
    filters = [(a.astype(np.float32), b.astype(np.float32)) for a, b in model.filters]
    return Model(model.index, model.embedding.astype(np.float32), filters, model.weights.astype(np.float32), model.bias, model.thresholds)


def scores_of(model: Model, texts: list) -> np.ndarray:
    out = [np.zeros(0)]
    for k in range(0, len(texts), 256):
        words, first = hashed_words(texts[k : k + 256])
        kinds, numbers = _numbered(model.index[words])
        windows, text = _windows(numbers[:, None], first)
        value = _logits(model, kinds, windows[:, :, 0], text, len(first) - 1)
        out.append(1 / (1 + np.exp(-np.clip(value.astype(float), -30, 30))))
    return np.concatenate(out)


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, score, lang, threshold and rejected of every whole text.

    The score sees the text alone.  Its language only picks the threshold: the language's
    own where calibration had enough toxic rows, else 0.5.  Null or empty text gets the
    score of a text without words; null ids and languages are kept; repeated rows are
    scored each; other columns are ignored.
    """
    small = _compact(model)

    def run(batches):
        for batch in batches:
            scores = pa.array(scores_of(small, batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), scores, batch.column(2)], ["doc_id", "score", "lang"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    scored = rows.mapInArrow(run, "doc_id long, score double, lang string")
    threshold = F.lit(0.5)
    for name, cut in model.thresholds.items():
        threshold = F.when(F.col("lang") == name, cut).otherwise(threshold)
    return scored.withColumn("threshold", threshold).withColumn("rejected", F.col("score") >= F.col("threshold"))


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of `docs` whose score stays below their language's threshold, all columns as they are."""
    small = _compact(model)

    def run(batches):
        for batch in batches:
            scores = scores_of(small, batch.column(text_col).to_pylist())
            cuts = np.array([small.thresholds.get(x, 0.5) for x in batch.column(lang_col).to_pylist()])
            yield batch.filter(pa.array(scores < cuts))

    return docs.mapInArrow(run, docs.schema)
