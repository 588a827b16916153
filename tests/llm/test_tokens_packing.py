import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldwatch.llm import packing, tokens

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
SCHEMA = "doc_id long, text string, ids string"


def plain(name, texts):
    return [e for e in tokens.Encoder(public_tokenizers.path(name)).plain(texts)]


@pytest.mark.parametrize("name", FILES)
def test_ids_equal_those_of_the_tokenizer(name):
    draw = random.Random(3)
    odd = ["", " ", "\n", "a  b", "a \n b", "a\n\nb", "x<|endoftext|>y z", "a | b|", "don't it's", "\x00 a", "a\u0085b c", "a\x1cb", "Σας ΣΑΣ", "naïve café\nline"]
    signs = list("ab1 .,'\n\t|<>é́") + [" "] * 6 + ["\n"] * 2
    odd += ["".join(draw.choice(signs) for _ in range(draw.randint(0, 40))) for _ in range(1500)]
    encode = tokens.Encoder(public_tokenizers.path(name))
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.encode(odd)] == encode.plain(odd)
    assert [np.frombuffer(x, "<u4").tolist() for x in encode.encode(odd)] == encode.plain(odd)


@given(st.lists(st.integers(0, 3000), max_size=60))
@settings(max_examples=80, deadline=None)
def test_packing_holds_every_token_once_without_padding(lengths):
    seen = {k: [] for k in range(len(lengths))}
    for size, pieces in packing.pack(lengths):
        total = sum(p[2] for p in pieces)
        assert total == size and (size in packing.TIERS or size & (size - 1) == 0)
        for doc, start, length in pieces:
            assert length > 0
            seen[doc].append((start, length))
    for doc, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[doc]):
            assert start == at
            at += length
        assert at == n


def test_step_groups_hold_one_size_and_like_costs():
    draw = random.Random(5)
    sequences = packing.pack([draw.randint(1, 900) for _ in range(2000)])
    groups, n = packing._step_groups(sequences, 8192)
    sizes, cost = {}, {}
    for (size, pieces), g in zip(sequences, groups):
        sizes.setdefault(g, set()).add(size)
        cost.setdefault((size, g), 0)
        cost[size, g] += sum(p[2] ** 2 for p in pieces)
    assert all(len(s) == 1 for s in sizes.values()) and set(groups) == set(range(n))
    long = [c for (size, _), c in cost.items() if size == 1024]
    assert max(long) < 1.5 * min(long)


def test_pack_documents(spark):
    texts = ["one two", None, "", "w " * 3000, "one two", "x" * 50]
    df = spark.createDataFrame([(k if k != 4 else None, t, "clash") for k, t in enumerate(texts)], SCHEMA).coalesce(1)
    rows = packing.pack_documents(df, public_tokenizers.path(FILES[0])).collect()
    want = {k if k != 4 else None: [*x, 0] for k, x in enumerate(plain(FILES[0], [t or "" for t in texts]))}
    got = {}
    for r in sorted(rows, key=lambda r: r.start):
        assert r.doc_tokens == len(want[r.doc_id]) and len(r.ids) == 4 * r.length
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == want
    assert packing.pack_documents(df.limit(0), public_tokenizers.path(FILES[0])).count() == 0


def test_sequences_over_several_partitions(spark):
    """Offsets are gapless from 0, sequences full, their ids apart, whatever partition made them."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["one", "two", "Σας", "x1,"]) for _ in range(draw.choice([0, 3, 40, 700, 2500]))) for _ in range(120)]
    df = spark.createDataFrame([(k % 50, t, "clash") for k, t in enumerate(texts)], SCHEMA).repartition(5)
    rows = packing.pack_documents(df, public_tokenizers.path(FILES[0])).collect()
    sequences, groups = {}, {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
        groups.setdefault(r.step_group, set()).add(r.context)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at == pieces[0].context and (at == 1024 or at & (at - 1) == 0)
        assert len({(r.context, r.step_group) for r in pieces}) == 1
    assert len({k >> 36 for k in sequences}) == 5 and all(len(c) == 1 for c in groups.values())
    assert sum(r.length for r in rows) == sum(len(x) + 1 for x in plain(FILES[0], texts))


@pytest.mark.parametrize("wide", [False, True])
def test_token_files_round_trip(spark, tmp_path, wide):
    texts = ["b c", None, "", "word " * 500, "été\nhier", "b c"]
    keys = [40, 7, 9, -3, 1000, None]
    df = spark.createDataFrame([(k, t, "clash") for k, t in zip(keys, texts)], SCHEMA).repartition(3)
    folder = str(tmp_path / "files")
    manifest = tokens.write_token_files(df, public_tokenizers.path(FILES[1]), folder, end_id=1, wide=wide)
    rows = sorted(tokens.read_token_files(manifest, f"file://{folder}", wide=wide, step=2).collect(), key=lambda r: r.doc_id)
    pairs = sorted(zip([k if k is not None else -(2**63) for k in keys], plain(FILES[1], [t or "" for t in texts])))
    at = 0
    for r, (key, ids) in zip(rows, pairs, strict=True):
        flat = np.array([*ids, 1], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) == (key, at, len(ids) + 1, zlib.crc32(flat))
        at += len(ids) + 1
    assert tokens.read_token_files(manifest, f"file://{folder}", wide=wide).rdd.getNumPartitions() == manifest.count()
    empty = tokens.write_token_files(df.limit(0), public_tokenizers.path(FILES[1]), folder)
    assert tokens.read_token_files(empty, folder).count() == 0
