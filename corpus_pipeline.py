"""The corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage takes ``(spark, docs, sf_dir)`` and returns what it keeps of ``docs``; all but the last return the columns of
``documents``, the last adds ``shard`` and ``slot``. Stages meet as Parquet tables, so when one begins, its predecessor's
intermediate tables are no longer needed and go.

Null, empty, repeated and very long texts pass as each stage's operator says: quality rules reject texts without words, so what follows has
words; rows without a key stay where a stage can't tell them apart. An empty table gives an empty result with the same columns.
"""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from chatloom.llm import decontamination, mixing, ngram_join, quality, sharding
from chatloom.scratch import recorded, release_paths, written

#: By stage, the intermediate tables that it has written; each thread has its own.
_tables: ContextVar[dict[str, list[str]] | None] = ContextVar("tables", default=None)


def _stage(after: str | None = None) -> Callable:
    """A stage that removes the intermediate tables of the stage ``after`` which it comes, whose result it is given as a table."""
    def wrap(work: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            own = _tables.get()
            if own is None:
                _tables.set(own := {})
            release_paths(spark, own.pop(after, []), keep=docs)
            with recorded() as made:
                out = work(spark, docs, sf_dir)
            own.setdefault(work.__name__, []).extend(made)
            return out

        run.__name__, run.__doc__ = work.__name__, work.__doc__
        return run

    return wrap


@_stage()
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return quality.kept_documents(docs)


@_stage(after="quality_rules")
def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose word shingles overlap by four fifths or more."""
    return ngram_join.kept_one_of_each(docs)


@_stage(after="one_of_each_group")
def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_stage(after="without_benchmark")
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources at their target weights takes them."""
    return mixing.mixed_documents(docs)


@_stage(after="mix_sources")
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in random order, dealt to the shards."""
    return sharding.shard_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("ngram_jaccard_join", one_of_each_group),
    ("benchmark_decontamination", without_benchmark),
    ("mix_sources", mix_sources),
    ("sharding", shard),
]

#: Neither the shuffle nor the estimated rule accuracies can be expressed in SQL; see the tests.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not shard:
            docs = written(docs, f"pipeline-{name}")
    return docs
