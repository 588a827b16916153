import math
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from fieldwatch.llm import mixing, templates, toxicity

# Names of results and of helper columns ride along as extra columns.
EXTRA = ["forms", "_t1", "_t3", "_cut", "_lines", "_gone", "gone_forms", "line_doc", "form_hash", "hash", "leaf", "form", "doc", "c0", "c1"]
DOCS = "doc_id long, text string, n_lines string, n_removed string, source string, " + ", ".join(f"{c} string" for c in EXTRA)


def lines_of(spark, texts, **options):
    df = spark.createDataFrame([(k, t, "clash", "clash", "s", *EXTRA) for k, t in texts], DOCS)
    out = templates.dedup_lines(df, **options)
    assert out.columns == ["doc_id", "text", "source", *EXTRA, "n_lines", "n_removed"]
    rows = out.collect()
    assert all([r[c] for c in EXTRA] == EXTRA for r in rows)
    return {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in rows}


def test_lines_of_long_texts_and_no_rows(spark):
    long = "\n".join(f"word{k} alone on its line" for k in range(20_000))
    got = lines_of(spark, [(k, f"{long}\nshared line of all five\nend {k}") for k in range(2)] + [(k, "shared line of all five") for k in range(2, 7)])
    assert [got[k][2] for k in range(7)] == [0] + [1] * 6 and got[1][1] == 20_002
    assert spark.createDataFrame([], DOCS).transform(templates.dedup_lines).count() == 0


def test_templates_generalise_variable_fields(spark):
    texts = [(k, f"body {chr(97 + k)} alone here\nPosted by user{chr(97 + k)} on the old main board 2021-0{k}-03\nPage {k} of 9\n") for k in range(6)]
    texts += [(10, None), (11, ""), (12, "\n \n"), (13, "Page 7 of 8")]
    got = lines_of(spark, texts)
    assert got[0] == (texts[0][1], 4, 0)
    for k in range(1, 6):
        assert got[k] == (f"body {chr(97 + k)} alone here\n", 4, 2)
    assert got[10] == (None, 0, 0) and got[11] == ("", 1, 0) and got[12] == ("\n \n", 3, 0) and got[13] == ("", 1, 1)


def test_lines_in_few_documents_or_often_in_one_stay(spark):
    got = lines_of(spark, [(1, "same line here\n" * 9), (2, "same line here"), (3, "other line\nsame line here"), (4, "x")])
    assert all(v[2] == 0 for v in got.values())


def test_copies_of_the_first_document_keep_its_lines(spark):
    got = lines_of(spark, [(k, "hot line of all\nsecond part") for k in range(8)] + [(9, "hot line of all\nmine"), (None, "hot line of all")])
    assert all(got[k][2] == 0 for k in range(8)) and got[9] == ("mine", 2, 1) and got[None] == ("", 1, 1)
    assert lines_of(spark, [(1, "a")]) == {1: ("a", 1, 0)}


def test_each_row_is_taken_for_itself(spark):
    """Ids that repeat with texts of different length, and null ids: no row more often than twice."""
    rows = [(k // 3 if k % 4 else None, f"row{k} " * (1 + k % 7), "ab"[k % 2], k, "x", "y") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, copies string, row_no string").repartition(3)
    out = mixing.mix_documents(df)
    assert out.columns == df.columns
    times = defaultdict(int)
    for r in out.collect():
        assert r.text == rows[r.key][1] and r.doc_id == rows[r.key][0]
        times[r.key] += 1
    plan = mixing.mix_sources(df).collect()
    assert sum(times.values()) == sum(r.copies for r in plan) and max(times.values()) <= 2
    assert mixing.mix_documents(df.limit(0)).count() == 0


def test_loops_that_do_not_end_say_so(spark):
    import fieldwatch.llm.components as c

    chain = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError):
        c.components(chain, most_rounds=1)
    cells = spark.createDataFrame([(0, 5, 10, 1.0, 100, 20.0, 60.0), (0, 9, 5, 1.8, 100, 20.0, 60.0)], "source_no int, size long, n long, x double, source_size long, scale double, target double")
    with pytest.raises(RuntimeError):
        mixing.balance(cells, most_steps=1)


def test_the_bounded_filter_keeps_every_key(spark):
    from pyspark.sql import functions as F

    from fieldwatch.llm.common import likely_in

    rows = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), (F.col("id") % 5).alias("_slot_bits"))
    keys = spark.range(0, 20_000, 40).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("k"))
    kept = likely_in(rows, F.col("key"), keys, F.col("k"))
    assert kept.columns == ["key", "_slot_bits"] and kept.join(keys, F.col("key") == F.col("k")).count() == 500 and kept.count() < 520
    assert likely_in(rows, F.col("key"), keys.limit(0), F.col("k")).count() == 0


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix_sources(df)


def test_mixing_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 16)
    draw = np.random.default_rng(4)
    rows = []
    for s, n in (("a", 400), ("b", 100), ("é", 60), (None, 30), ("z", 3), ("blank", 2)):
        rows += [(len(rows) + k, "w " * int(0 if s == "blank" else draw.integers(1, 60)), s) for k in range(n)]
    got = mixed(spark, rows).collect()
    assert len(got) == len(rows)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.source_size == sum(len(t.split()) for _, t, s in rows if s == r.source)
        assert 0 <= r.copies <= 2 and r.taken == r.copies * r.size
    # brute force: reshare until nobody is above the limit
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight, open_, left, want = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, set(order), 1.5 * sum(size.values()), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * size[s]]
        if not over:
            want.update(share)
            break
        for s in over:
            want[s] = 2.0 * size[s]
            left -= want[s]
            open_.discard(s)
    for s in order:
        assert math.isclose(target[s], want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - want[s]) <= max(2, 0.01 * want[s])
    rates = {(r.source, r.size): r.rate for r in got if r.source == "a" and r.size}
    tilt = {round(math.log(v) / k[1], 9) for k, v in rates.items() if 0 < v < 2}
    assert len(tilt) == 1
    again = {r.doc_id: r.copies for r in mixed(spark, list(reversed(rows))).collect()}
    assert again == {r.doc_id: r.copies for r in got}


def test_mixing_corner_cases(spark):
    got = mixed(spark, [(1, None, "a"), (2, "", None), (None, "x y", "a"), (3, "x", "a"), (3, "x", "a")]).collect()
    assert len(got) == 5 and all(r.taken <= 2 * r.size for r in got)
    assert mixed(spark, [(1, "a", "b")]).where("doc_id < 0").count() == 0
    df = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix_sources(df).count() == 0


@pytest.fixture(scope="module")
def corpus():
    draw = np.random.default_rng(8)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(900):
        text = draw.choice(words, draw.integers(5, 60)).tolist()
        toxic = int(k % 6 == 0)
        if toxic:
            text[len(text) // 2] = str(draw.choice(["scum", "Vermin,", "filthyX", "filthyY"]))
        rows.append((k, " ".join(text), "xx" if k % 2 else None, toxic))
    return rows


def test_toxicity_learns_and_ignores_everything_but_the_text(spark, corpus):
    docs = spark.createDataFrame([(*r[:3], "s", 1) for r in corpus] + [(5000, None, "xx", "s", 1), (5001, "", None, "s", 1), (5002, "filthyZ friend", "yy", "s", 1)], "doc_id long, text string, lang string, source string, score int")
    labels = spark.createDataFrame([(r[0], r[3]) for r in corpus] + [(None, 1), (7777, None)], "doc_id long, toxic int")
    model = toxicity.fit_model(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_documents(docs, model).collect()}
    assert len(got) == len(corpus) + 3 and all(0 <= r.score <= 1 for r in got.values())
    right = sum((got[k].score >= 0.5) == bool(t) for k, _, _, t in corpus)
    assert right > 0.97 * len(corpus)
    assert got[5000].score == got[5001].score < 0.5 and got[5002].score > 3 * got[5000].score
    moved = docs.selectExpr("doc_id + 10000 AS doc_id", "text", "'zz' AS lang")
    other = {r.doc_id - 10000: r.score for r in toxicity.score_documents(moved, model).collect()}
    assert other == {k: r.score for k, r in got.items()}
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if not r.rejected}
    again = toxicity.fit_model(docs.repartition(5), labels)
    assert np.array_equal(again.weights, model.weights)


def test_toxicity_without_usable_labels(spark, corpus):
    docs = spark.createDataFrame([r[:3] for r in corpus[:20]], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(r[0], 0) for r in corpus[:20]], "doc_id long, toxic int")
    for labels in (none, one):
        scores = {r.score for r in toxicity.score_documents(docs, toxicity.fit_model(docs, labels)).collect()}
        assert len(scores) == 1 and max(scores) < 0.5


def test_toxicity_learns_from_every_labelled_row(spark, monkeypatch):
    """More rows than any bound on a sample: a word that few of many shards hold counts fully."""
    rows = [(k, f"plain text{k % 50} " + ("vile" if k % 10 == 0 else "kind"), "xx", int(k % 10 == 0)) for k in range(12_000)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, toxic int")
    kept = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    known = toxicity.known_labels(labels, "doc_id")
    counts = toxicity.count_buckets(docs.withColumnRenamed("doc_id", "id").join(known, "id"))
    assert len(kept) > 8_000 and counts[:, :, -1].sum() == len(kept)
    assert counts[:, 1, -1].sum() == sum(r[3] for r in kept)
    words, _ = toxicity.hashed_words(["vile"])
    assert counts[:, 1, words[0, 0]].sum() == sum(r[3] for r in kept) and counts[:, 0, words[0, 0]].sum() == 0
    trained = []
    epoch = toxicity.average_epoch

    def watched(shards, states, number, *rest):
        if not trained:
            trained.extend(r.n for r in shards.collect())
        return epoch(shards, states, number, *rest)

    monkeypatch.setattr(toxicity, "average_epoch", watched)
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 2_500)
    monkeypatch.setattr(toxicity, "EPOCHS", 3)
    model = toxicity.fit_model(docs, labels)
    assert sum(trained) == len(kept) and len(trained) > 2
    wrong = [r.doc_id for r in toxicity.score_documents(docs, model).collect() if (r.score >= 0.5) != (r.doc_id % 10 == 0)]
    assert not wrong


def test_windows_from_places_equal_those_of_all_words():
    draw = np.random.default_rng(4)
    sizes = [0, 1, 2, 3, 9, 0, 40, 1]
    first = np.concatenate(([0], np.cumsum(sizes)))
    words = np.where(draw.random((first[-1], 3)) < 0.15, draw.integers(1, 9, (first[-1], 3)), 0).astype(np.int32)
    words[first[3]] = words[first[7]] = 5
    place = np.flatnonzero(words.any(axis=1))
    text = np.repeat(np.arange(len(sizes)), sizes)[place]
    want, got = toxicity._windows(words, first), toxicity._windows_of_places(text, place - first[text], words[place])
    assert np.array_equal(want[0], got[0]) and np.array_equal(want[1], got[1])
    assert toxicity._windows_of_places(text[:0], place[:0], words[:0])[0].shape == (0, 3, 3)


def test_gradients_lower_the_loss():
    rows = pd.DataFrame({"toxic": [1, 0] * 40})
    words = [f"bad tail{k % 7}" if k % 2 == 0 else f"good tail{k % 7}" for k in range(80)]
    flat, first = toxicity.hashed_words(words)
    model = toxicity.train(flat, first, rows["toxic"])
    value = toxicity.logits(model, *toxicity._windows(model.index[flat], first), 80)
    assert ((value > 0) == (rows["toxic"].to_numpy() == 1)).all()


def test_scores_equal_a_plain_loop():
    """Embeddings summed, each filter over every place of the padded text, the largest response kept."""
    draw = np.random.default_rng(11)
    texts = ["", "a", "bad words here and bad again", "fine text with nothing in it", "bad", "x " * 40 + "bad words"] * 4
    labels = [0, 0, 1, 0, 1, 1] * 4
    words, first = toxicity.hashed_words(texts)
    model = toxicity.train(words, first, labels, epochs=2)
    model.embedding[1:] += draw.normal(0, 0.3, model.embedding[1:].shape)
    got = toxicity.logits(model, *toxicity._all_windows(model.index, words, first), len(texts))
    for k in range(len(texts)):
        own = [model.embedding[model.index[w]].sum(axis=0) for w in words[first[k] : first[k + 1]]]
        zero = np.zeros(model.embedding.shape[1])
        longest = max(toxicity.WIDTHS)
        pooled = []
        for width, (a, b) in zip(toxicity.WIDTHS, model.filters):
            best = np.maximum(b, 0)
            for at in range(-longest + 1, len(own) + 1):
                window = [own[i] if 0 <= i < len(own) else zero for i in range(at, at + width)]
                best = np.maximum(best, sum(x @ w for x, w in zip(window, a)) + b)
            pooled.append(best)
        assert got[k] == pytest.approx(np.concatenate(pooled) @ model.weights + model.bias)


def test_training_goes_by_distinct_words_and_keeps_its_gradients():
    """An epoch over numbered words against the gradient of the loss by differences; texts without any word in use."""
    draw = np.random.default_rng(7)
    ids = np.concatenate(([[0, 0, 0]], draw.integers(0, 5, (9, 3)))).astype(np.int32)
    rows, text = draw.integers(0, 10, (60, 3)).astype(np.int32), np.sort(draw.integers(0, 14, 60))
    labels = draw.integers(0, 2, 16)
    filters = [(draw.normal(0, 0.5, (w, toxicity.EMBEDDING, toxicity.FILTERS)), -draw.random(toxicity.FILTERS)) for w in toxicity.WIDTHS]
    embedding = draw.normal(0, 0.5, (5, toxicity.EMBEDDING))
    embedding[0] = 0
    state = toxicity.State.of(toxicity.Model(None, embedding, filters, draw.normal(0, 0.5, toxicity.FILTERS * len(toxicity.WIDTHS)), 0.1))

    def loss(params):
        value = toxicity._logits(state.filled(np.concatenate([p.ravel() for p in params] * 3), 0).model(None), ids, rows, text, len(labels))
        return np.mean(np.log1p(np.exp(value)) - labels * value)

    before = [p.copy() for p in state.params]
    toxicity.train_epoch(state, ids, rows, text, labels, draw, rate=0.0, decay=0.0)
    for k, (p, m) in enumerate(zip(before, state.first)):
        for at in list(np.ndindex(p.shape))[toxicity.EMBEDDING if k == 0 else 0 :: 7]:
            slope = []
            for step in (1e-6, -1e-6):
                moved = [q.copy() for q in before]
                moved[k][at] += step
                slope.append(loss(moved))
            assert m[at] == pytest.approx(0.1 * (slope[0] - slope[1]) / 2e-6, abs=1e-7)
    toxicity.train_epoch(state, ids, rows[:0], text[:0], labels, draw)
    assert all(np.isfinite(p).all() for p in state.params)


def test_what_toxicity_shuffles_is_smaller_than_the_text(spark, monkeypatch):
    """No shuffle of whole texts: buckets and words in use come back as they were, and only likely labelled rows pass."""
    draw = np.random.default_rng(9)
    text = " ".join(f"w{k}" for k in draw.zipf(1.3, 4000) % 5000)
    words, first = toxicity.hashed_words([text, None, "one two"])
    for seen, (a, b) in zip(toxicity._seen(words, first), zip(first, first[1:])):
        assert np.array_equal(toxicity._sum_up(toxicity._steps(seen)), np.unique(words[a:b]))
        assert len(toxicity._steps(seen)) < max(30, len(text) // 2)
    slots = draw.integers(-5, 3000, (50, 3)).astype(np.int16)
    assert np.array_equal(toxicity._spread(toxicity._squeezed(slots), np.int16).reshape(-1, 3), slots)
    passed = []
    used = toxicity.used_words
    monkeypatch.setattr(toxicity, "used_words", lambda docs, slot: (passed.append((docs.count(), docs.columns)), used(docs, slot))[1])
    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    docs = spark.createDataFrame([(k, "vile" if k % 3 else "kind", "xx") for k in range(600)], "doc_id long, text string, lang string")
    toxicity.fit_model(docs, spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, toxic int"))
    assert passed[0][0] < 60
