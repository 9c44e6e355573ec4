"""The corpus pipeline: toxicity, quality rules, near-dedup, mixing, piece encoding.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
All stages but the last return the columns of ``documents``. Null texts count as empty,
null ids and sources are values like others, repeated rows are rows of their own until
near-dedup keeps one, further columns are carried through whatever their names, and an
empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rotagraph.llm import mixing, pieces, rules, simhash, toxicity
from rotagraph.llm.queries import tokenizer_path
from rotagraph.session import table, written

#: No source is given more often than this; every document is given once at least.
MOST_REPEATS = 1.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier scores below its threshold; without labels
    of both kinds it keeps all."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that neither the base rules nor the learned list reject. Empty
    texts go; without labels the list is empty."""
    learned = rules.fit(docs, table(spark, sf_dir, "labels"))
    return rules.keep_quality(docs, learned)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: that of the smallest id, null ids
    last. Copies are linked by fingerprints of at most four differing bits, and by similar
    sets of five-word shingles. All empty texts are one group."""
    return simhash.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Gives the documents of each source as often as the mixture's weight asks for, so an id
    may come more than once from here on. A null source is a source."""
    return mixing.mixed_documents(docs, most_repeats=MOST_REPEATS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_pieces): the piece ids of every document given; none for an empty text."""
    return pieces.encode_pieces(docs.select("doc_id", "source", "text"), tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("piece encoding", encode),
]

#: A classifier, a fingerprint and a tokenizer have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result but the last is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
