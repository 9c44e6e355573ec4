"""What several operators need: words, bounded samples of labels, Arrow batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: White space between words, as a Java or Python character class: space, tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def is_remainder(column: str, modulus: int, remainder: int):
    """crc32 of the column's text mod ``modulus`` is ``remainder``; null counts as ''."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus == remainder


def words_of(column):
    """The words of a text column, in order; null gives an empty array."""
    return F.filter(F.split(F.coalesce(column, F.lit("")), SPACE), lambda w: w != "")


def packed(df: DataFrame, **columns) -> DataFrame:
    """One struct ``_row`` with all columns of ``df``, and ``columns``: whatever names rows
    bring, they cannot clash with those of an operator."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[v.alias(k) for k, v in columns.items()])


def unpacked(df: DataFrame, names: list[str], *more) -> DataFrame:
    """The columns ``names`` of ``_row``, and ``more``."""
    return df.select(*[F.col("_row").getField(c).alias(c) for c in names], *more)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, bound: int, keep=None) -> DataFrame:
    """(id, text, y, weight): at most ``bound`` labelled rows of each class, those of the
    smallest hashes of their ids, joined to their texts. ``bound`` is the documented limit of
    what a classifier is fitted on; the small side is broadcast, as its size is known.
    Null ids and labels other than 0 and 1 are void; an id with both labels counts as 1.
    ``weight``: how many labelled ids of its class, all counted, a chosen one stands for.
    Of several rows with a chosen id the text of the smallest hash is kept, by partial
    aggregation, so copies of one id never gather."""
    known = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("y")).where("_id IS NOT NULL AND y IN (0, 1)")
    if keep is not None:
        known = known.where(keep("_id"))
    known = known.groupBy("_id").agg(F.max("y").alias("y"))
    parts = [known.where(F.col("y") == y).orderBy(F.xxhash64("_id"), "_id").limit(bound) for y in (0, 1)]
    sizes = known.groupBy("y").agg(F.count("*").alias("n"))
    chosen = parts[0].unionByName(parts[1]).join(F.broadcast(sizes), "y").select("_id", "y", (F.col("n") / F.least("n", F.lit(bound))).alias("weight"))
    texts = docs.select(F.col(id_col).alias("_id"), F.col("text"))
    rows = texts.join(F.broadcast(chosen), "_id")
    one = rows.groupBy("_id", "y", "weight").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("_least"))
    return one.select("_id", F.col("_least.text").alias("text"), "y", "weight")


def map_batches(df: DataFrame, f, schema: str) -> DataFrame:
    """``mapInArrow`` with a function of one ``RecordBatch`` that returns columns as a dict."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = f(batch)
                yield pa.RecordBatch.from_arrays([pa.array(out[x.name], type=x.type) for x in arrow], schema=arrow)
        release()

    return bounded(df).mapInArrow(run, schema)


def utf8(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8 bytes; null gives b''."""
    got = batch.column(batch.schema.get_field_index(column))
    kind = pa.large_binary() if pa.types.is_large_string(got.type) else pa.binary()
    return [x or b"" for x in got.cast(kind).to_pylist()]


#: Bytes of rows that one Arrow batch hands to a Python worker.
BATCH_BYTES = 8 << 20


def bounded(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches are bounded by bytes, not only by rows. A
    bound that the session has set itself stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    conf = df.sparkSession.conf
    if conf.get(key).rstrip("bB") == str((1 << 31) - 1):
        conf.set(key, str(BATCH_BYTES))
    return df


def release() -> None:
    """Gives freed memory of a worker back to the system: workers live on between stages,
    and what one of them once needed would otherwise stay its own."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass
