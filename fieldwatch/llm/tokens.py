"""Token ids of texts, and their flat binary files."""

from __future__ import annotations

import itertools
import re
import uuid
import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldwatch.session import work_path

#: Words whose ids a worker remembers; beyond that it starts anew.
CACHE_WORDS = 450_000
#: Words of the small table.
COMMON_WORDS = 16_000
#: A text is cut before single spaces and around single line ends, each between other characters.
CUT = re.compile(r"(?<=\S)(?= \S)|(?<=\S)(?=\n\S)|(?<=\S\n)(?=\S)")
#: A point or comma that does not follow a letter or digit; without any, texts are also cut before those two.
ODD_POINT = re.compile(r"[.,](?<![^\W_][.,])")
_ENCODERS: dict = {}


def _latin(text: str) -> bool:
    """Whether a text stays the same under composition and has plain lower-case forms."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Encoder:
    """Ids of whole texts, equal to those of the tokenizer, as little-endian bytes.

    Both public vocabularies split a text before every single space and around every
    single line end that stand between other characters, whatever follows, and before
    points and commas after a letter or digit; so the words between are encoded once,
    remembered, and joined.  The vocabulary without white space also ignores case, so
    there words are remembered in lower case where that is the same.  The commonest
    words of a worker's first texts are kept in a small table that is asked first.  What a single space or line end
    gives between words is asked of the tokenizer itself: the byte-level vocabulary
    glues the space to the next word and gives the line end an id of its own, the other
    drops both.  Words that are new in a batch go to the tokenizer in one call.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.glued = self.plain(["a b"])[0] != self.plain(["a"])[0] + self.plain(["b"])[0]
        self.words: dict[str, bytes] = {}
        self.common: dict[str, bytes] = {}
        self.mark = "\n" if self.glued else " | "
        self.mark_id = self.plain(["\n" if self.glued else "|"])[0]

    def plain(self, texts) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str) -> list[str]:
        """Words in order; glued vocabularies keep the space before a word and line ends."""
        apart = not ODD_POINT.search(text)
        if not self.glued:
            if apart:
                text = text.replace(".", " .").replace(",", " ,")
            return (text.lower() if _latin(text) else text).replace("\n", " ").split(" ")
        odd = "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] in " \n" or text[-1] in " \n"
        if odd or not text.replace("\n", "").isprintable():
            return list(filter(None, CUT.split(text)))
        if apart:
            text = text.replace(".", "\0.").replace(",", "\0,")
        return text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")

    def _learn(self, new: list[str]) -> None:
        bar = self.mark.strip(" ")
        easy = [w for w in new if bar not in w and w and "<|" not in w and (not self.glued or not (w[-1].isspace() or w[:2].isspace()))]
        hard = set(new).difference(easy)
        for k in range(0, len(easy), 2000):
            part = easy[k : k + 2000]
            ids = np.array(self.plain([self.mark.join(part)])[0], "<u4")
            ends = np.flatnonzero(ids == self.mark_id[0])
            if len(self.mark_id) != 1 or len(ends) != len(part) - 1:
                hard.update(part)
                continue
            starts = [0, *(ends + 1).tolist()]
            flat = ids.tobytes()
            for word, a, b in zip(part, starts, [*ends.tolist(), len(ids)]):
                self.words[word] = flat[4 * a : 4 * b]
        hard = list(hard)
        for word, ids in zip(hard, self.plain(hard)):
            self.words[word] = np.array(ids, "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as unsigned little-endian 32-bit integers."""
        cut = [self._cut(t) if t else [] for t in texts]
        if not self.common and sum(map(len, cut)) >= 100_000:
            often = Counter(itertools.chain.from_iterable(cut)).most_common(COMMON_WORDS)
            self._learn([w for w, _ in often if w not in self.words])
            self.common = {w: self.words[w] for w, _ in often}
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        first, get, found, rare = self.common.get, self.words.get, [], []
        for words in cut:
            known = list(map(first, words))
            gaps = [k for k, ids in enumerate(known) if ids is None]
            found.append(known)
            rare.append((known, gaps, [words[k] for k in gaps]))
        new = set()
        for _, _, words in rare:
            new.update(words)
        new.difference_update(self.words)
        if new:
            self._learn(list(new))
        for known, gaps, words in rare:
            for k, ids in zip(gaps, map(get, words)):
                known[k] = ids
        return [b"".join(known) for known in found]


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary; workers serve many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def portions(texts, most_chars: int = 4_000_000):
    """Slices (start, end) of a list of texts that hold about so many characters."""
    start, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t) if t else 0
        if held >= most_chars:
            yield start, k + 1
            start, held = k + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, wide: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write token files in ascending id order; returns the manifest, one row per shard.

    A shard is three flat files: ids (unsigned 16-bit integers, 32-bit if `wide`),
    offsets (n + 1 unsigned 64-bit positions in ids, from 0) and the documents' own ids
    (signed 64-bit).  Documents are dealt into shards by ranges of their id, each shard
    by one task in batches.  A task writes under a name of its own and returns it, so a
    repeated attempt never touches another's files and only files named by a
    successful attempt count.  A shard's base, the ids in all shards before it, is a
    prefix sum over one row per shard.

    Null text counts as empty; null ids come first and are stored as -2^63; rows that
    repeat an id stay side by side, ordered by their text.
    """
    kind = "<u4" if wide else "<u2"

    def write(batches):
        encode = encoder(tokenizer_path)
        name, files, counts, keys, total = uuid.uuid4().hex, None, [0], [], 0
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            if not len(batch):
                continue
            if files is None:
                where, base = _open(folder)
                where.create_dir(base, recursive=True)
                files = {part: where.open_output_stream(f"{base}/{name}.{part}") for part in ("ids", "offsets", "docs")}
                files["offsets"].write(np.zeros(1, "<u8").tobytes())
                first = int(batch["doc_id"].iloc[0])
            texts = batch["text"].tolist()
            for a, b in portions(texts):
                flat = [x + end for x in encode.encode(texts[a:b])]
                ids = np.frombuffer(b"".join(flat), "<u4")
                if len(ids) and not wide and int(ids.max()) > 0xFFFF:
                    raise ValueError("ids need wide files")
                files["ids"].write(ids.astype(kind).tobytes())
                ends = total + np.cumsum([len(x) // 4 for x in flat])
                files["offsets"].write(ends.astype("<u8").tobytes())
                total = int(ends[-1])
            files["docs"].write(batch["doc_id"].to_numpy("int64").astype("<i8").tobytes())
            counts.append(len(batch))
            last = int(batch["doc_id"].iloc[-1])
        if files is not None:
            for f in files.values():
                f.close()
            yield pd.DataFrame({"shard": [name], "first_id": [first], "last_id": [last], "n_docs": [sum(counts)], "n_tokens": [total]})

    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    sorted_rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    found = sorted_rows.mapInPandas(write, "shard string, first_id long, last_id long, n_docs long, n_tokens long")
    shards = sorted(found.collect(), key=lambda r: (r.first_id, r.last_id))
    bases = np.cumsum([0, *[r.n_tokens for r in shards]]).tolist()
    manifest = [(r.shard, r.first_id, r.last_id, r.n_docs, r.n_tokens, b) for r, b in zip(shards, bases)]
    spark = docs.sparkSession
    return spark.createDataFrame(manifest, "shard string, first_id long, last_id long, n_docs long, n_tokens long, base long")


def read_token_files(manifest: DataFrame, folder: str, wide: bool = False, step: int = 2048) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids (little-endian 32-bit bytes).

    Files on a mounted folder are memory-mapped; others are read by range.
    """
    kind = np.dtype("<u4" if wide else "<u2")

    def read(batches):
        where, base = _open(folder)
        for batch in batches:
            for shard, first in zip(batch["shard"], batch["base"]):
                if where.type_name == "local":
                    load = lambda part, dtype: np.memmap(f"{base}/{shard}.{part}", dtype=dtype, mode="r")
                    ids, close = load("ids", kind) if where.get_file_info(f"{base}/{shard}.ids").size else np.zeros(0, kind), None
                else:
                    load = lambda part, dtype: np.frombuffer(where.open_input_stream(f"{base}/{shard}.{part}").read(), dtype)
                    ids, close = None, where.open_input_file(f"{base}/{shard}.ids")
                offsets, docs = load("offsets", "<u8"), load("docs", "<i8")
                for a in range(0, len(docs), step):
                    b = min(a + step, len(docs))
                    lo, hi = int(offsets[a]), int(offsets[b])
                    if close is None:
                        flat = ids[lo:hi]
                    else:
                        close.seek(lo * kind.itemsize)
                        flat = np.frombuffer(close.read((hi - lo) * kind.itemsize), kind)
                    flat = flat.astype("<u4").tobytes()
                    at = offsets[a : b + 1].astype("int64")
                    cut = ((at - lo) * 4).tolist()
                    yield pd.DataFrame(
                        {"doc_id": np.array(docs[a:b]), "start": at[:-1] + first, "n_tokens": np.diff(at), "ids": [flat[x:y] for x, y in zip(cut, cut[1:])]}
                    )

    # A task for each shard: a stated number of partitions is not put together again.
    shards = manifest.select("shard", "base").repartition(max(1, manifest.count()))
    return shards.mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def token_folder(spark) -> str:
    return work_path(spark, "token-files")


def crc32(data: bytes) -> int:
    return zlib.crc32(data)
