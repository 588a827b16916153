"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; between
stages the rows are written as Parquet and read again.  All but the last return the
columns of `documents`.

Nulls and corner cases, by stage: null text is scored as empty, has no lines, fingerprint
0 and no words, and packs to its end id; an empty table passes through every stage;
columns beyond those of `documents` are dropped at the start of a stage that renames.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldwatch.llm import mixing, near_copies, packing, templates, toxicity
from fieldwatch.llm.common import drop, stored, table, unread, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


#: Tables that stages have stored for their results.
_held: list[str] = []


def stage(run_stage: Callable) -> Callable:
    """A stage whose stored tables go when a later stage starts from its written result.

    The result of a stage is a plan over tables it has stored.  The next stage reads the
    result from files of its own; whatever it does not read by then has had its last reader.
    """

    @wraps(run_stage)
    def run_it(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        gone = unread(_held, docs)
        drop(gone)
        _held[:] = [p for p in _held if p not in gone]
        before = set(written())
        out = run_stage(spark, docs, sf_dir)
        _held.extend(p for p in written() if p not in before)
        return out

    return run_it


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS[:-1], F.length("text").cast("long").alias("n_chars"))


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it learns from the labels outside fold 0."""
    docs = docs.select(*COLUMNS)
    return toxicity.drop_toxic(docs, toxicity.fit_model(docs, table(spark, sf_dir, "labels")))


@stage
def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of recurring templates stay in their first document and its copies only; no document goes."""
    return _documents(templates.dedup_lines(docs.select(*COLUMNS)))


@stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of their five-word shingles, one stays."""
    return near_copies.drop_near_copies(docs.select(*COLUMNS), shingle=5, similarity=0.8)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    return mixing.mix_documents(docs.select(*COLUMNS))


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 1024 and shorter powers of two, without padding."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing sources", mix),
    ("packing", pack),
]

#: Not expressible in SQL: a trained classifier, fingerprints over XXH64 and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, run_stage) in enumerate(STAGES):
        docs = run_stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
