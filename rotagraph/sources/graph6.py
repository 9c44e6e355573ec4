"""graph6 lines: decoding, validation and encoding as DataFrame expressions.

A line holds the order (one character, or ``~`` and three), then the upper triangle column
by column, six bits a character from 63 on, padded with zero bits.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Orders beyond this are an error.
LARGEST = 100_000
HEADER = ">>graph6<<"


def read_g6(spark: SparkSession, path: str) -> DataFrame:
    """(src, line_no, g6) of graph6 files, the header stripped; line numbers count within a
    file. Files are read by splits: a line's number is its place in the split and the lines
    of the splits before it, which one row a split brings together."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    splits = lines.groupBy("src", "block").agg(F.min("at").alias("first"), F.count("*").alias("lines"))
    earlier = Window.partitionBy("src").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("src", "block", "first", F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("before"))
    numbered = lines.join(splits, ["src", "block"])
    line = F.rtrim(F.col("value"), F.lit("\r"))
    return numbered.select("src", (F.col("before") + F.col("at") - F.col("first") + 1).cast("int").alias("line_no"), F.regexp_replace(line, "^>>graph6<<", "").alias("g6")).where("g6 != ''")


def order_of(g6: Column) -> Column:
    """n of a line."""
    code = lambda i: F.ascii(F.substring(g6, i, 1)) - 63
    return F.when(F.startswith(g6, F.lit("~")), code(2) * 4096 + code(3) * 64 + code(4)).otherwise(code(1))


def body_of(g6: Column) -> Column:
    return F.when(F.startswith(g6, F.lit("~")), F.substring(g6, 5, 1 << 30)).otherwise(F.substring(g6, 2, 1 << 30))


def body_length(n: Column) -> Column:
    """ceil(n (n - 1) / 12)."""
    n = n.cast("long")
    return F.expr("0").cast("long") + F.ceil(n * (n - 1) / 12)


def error_of(g6: Column) -> Column:
    """Why a line is not a graph, or null."""
    n, body = order_of(g6), body_of(g6)
    spare = (6 - F.pmod(F.expr("0") + (n.cast("long") * (n.cast("long") - 1)) / 2, F.lit(6))).cast("int")
    last = F.ascii(F.substring(body, -1, 1)) - 63
    return (
        F.when(g6.rlike("^(>>sparse6<<|>>digraph6<<|[:;&])"), "sparse6 and digraph6 are not supported")
        .when(~g6.rlike(r"^[\x3F-\x7E]+$"), "a character is out of range")
        .when(F.startswith(g6, F.lit("~~")) | (n > LARGEST), "the order is too large")
        .when(n < 1, "the order is zero")
        .when(F.length(body) != body_length(n), "the length does not fit the order")
        .when((F.length(body) > 0) & (spare < 6) & (last % F.pow(F.lit(2), spare).cast("int") != 0), "padding bits are set")
    )


def edges_of(graphs: DataFrame, id_col: str = "graph_id", g6: str = "g6") -> DataFrame:
    """(id, u, v), u < v, of valid lines: bit k is column v, row u with k = v (v - 1) / 2 + u."""
    chars = graphs.where(error_of(F.col(g6)).isNull()).select(id_col, F.posexplode(F.split(body_of(F.col(g6)), "")).alias("at", "c")).where("c != ''")
    bits = chars.select(id_col, "at", F.explode(F.filter(F.array(*[F.when(((F.ascii("c") - 63).bitwiseAND(1 << (5 - b))) != 0, F.lit(b)) for b in range(6)]), lambda b: b.isNotNull())).alias("b"))
    k = bits.select(id_col, (F.col("at").cast("long") * 6 + F.col("b")).alias("k"))
    v = F.floor((1 + F.sqrt(1 + 8 * F.col("k"))) / 2)
    k = k.withColumn("v", v).withColumn("v", F.when(F.col("v") * (F.col("v") - 1) / 2 > F.col("k"), F.col("v") - 1).otherwise(F.col("v")))
    return k.select(id_col, (F.col("k") - F.expr("v * (v - 1) div 2")).cast("int").alias("u"), F.col("v").cast("int").alias("v"))


def edge_array(g6: Column) -> Column:
    """The edges (u, v), u < v, of a line as an array within its row; none of an invalid line."""
    bits = lambda c: F.filter(F.array(*[F.when(((F.ascii(c) - 63).bitwiseAND(1 << (5 - b))) != 0, F.lit(b)) for b in range(6)]), lambda b: b.isNotNull())
    chars = F.filter(F.split(body_of(g6), ""), lambda c: c != "")
    k = F.flatten(F.transform(chars, lambda c, at: F.transform(bits(c), lambda b: at.cast("long") * 6 + b)))
    below = lambda v: F.call_function("div", v * (v - 1), F.lit(2))
    rough = F.transform(k, lambda k: F.struct(k.alias("k"), F.floor((1 + F.sqrt(1 + 8 * k)) / 2).alias("v")))
    exact = F.transform(rough, lambda x: F.struct(x["k"].alias("k"), F.when(below(x["v"]) > x["k"], x["v"] - 1).otherwise(x["v"]).alias("v")))
    edges = F.transform(exact, lambda x: F.struct((x["k"] - below(x["v"])).cast("int").alias("u"), x["v"].cast("int").alias("v")))
    return F.when(error_of(g6).isNull(), edges).otherwise(F.array().cast("array<struct<u:int,v:int>>"))


def order_prefix(n: Column) -> Column:
    char = lambda x: F.chr((x + 63).cast("int"))
    return F.when(n <= 62, char(n)).otherwise(F.concat(F.lit("~"), char(F.expr("0") + F.floor(n / 4096)), char(F.floor(n / 64) % 64), char(n % 64)))


def without_digraphs(texts: DataFrame, edges: DataFrame, column: str, id_col: str = "graph_id") -> DataFrame:
    """``texts`` with null in ``column`` where ``edges`` (id, ..., dir) hold a directed one, as
    the form has no directions. Edges without ``dir`` are undirected."""
    if "dir" not in edges.columns:
        return texts
    directed = edges.where("dir != 'UND'").select(id_col).distinct().withColumn("_directed", F.lit(True))
    return texts.join(directed, id_col, "left").withColumn(column, F.when(F.col("_directed").isNull(), F.col(column))).drop("_directed")


def encode(graphs: DataFrame, edges: DataFrame, id_col: str = "graph_id") -> DataFrame:
    """(id, n, m, g6) of ``graphs`` (id, n) and their ``edges`` (id, u, v[, dir]; u < v,
    distinct); g6 is null for digraphs. Bits are summed by character, then the characters of a
    graph meet in one row."""
    k = F.expr("CAST(v AS LONG) * (v - 1) div 2 + u")
    chars = (
        edges.withColumn("k", k)
        .groupBy(id_col, F.expr("k div 6").alias("at"))
        .agg(F.sum(F.pow(F.lit(2), 5 - F.col("k") % 6).cast("int")).cast("int").alias("x"), F.count("*").alias("bits"))
        .groupBy(id_col)
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("chars"), F.sum("bits").cast("int").alias("m"))
    )
    both = graphs.select(id_col, F.col("n").cast("int").alias("n")).join(chars, id_col, "left")
    size = body_length(F.col("n"))
    none = F.create_map().cast("map<bigint,int>")
    both = both.withColumn("chars", F.coalesce("chars", none))
    body = F.when(size > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), size - 1), lambda i: F.chr(F.coalesce(F.try_element_at("chars", i), F.lit(0)) + 63)), "")).otherwise("")
    return without_digraphs(both.select(id_col, "n", F.coalesce("m", F.lit(0)).alias("m"), F.concat(order_prefix(F.col("n")), body).alias("g6")), edges, "g6", id_col)


def parse_g6(line: str) -> tuple[int, list[tuple[int, int]]]:
    """n and edges of one line, in Python, for kernels."""
    if line.startswith(HEADER):
        line = line[len(HEADER) :]
    codes = [ord(c) - 63 for c in line]
    if not codes or min(codes) < 0 or max(codes) > 63:
        raise ValueError("a character is out of range")
    n, at = (codes[0], 1) if codes[0] < 63 else (codes[1] << 12 | codes[2] << 6 | codes[3], 4) if len(codes) > 3 and codes[1] < 63 else (0, 0)
    if not 0 < n <= LARGEST:
        raise ValueError("the order is zero or too large")
    body = codes[at:]
    if len(body) != -(-n * (n - 1) // 12):
        raise ValueError("the length does not fit the order")
    bits = "".join(map(_SIXES.__getitem__, body))
    size = n * (n - 1) // 2
    if "1" in bits[size:]:
        raise ValueError("padding bits are set")
    if n <= 64:
        pairs = _pairs(n)
        return n, [pairs[k] for k, bit in enumerate(bits[:size]) if bit == "1"]
    edges, start = [], 0
    for v in range(1, n):
        row = bits[start : start + v]
        edges += [(u, v) for u, bit in enumerate(row) if bit == "1"] if "1" in row else []
        start += v
    return n, edges


_SIXES = [format(x, "06b") for x in range(64)]


@lru_cache(64)
def _pairs(n: int) -> list[tuple[int, int]]:
    """The pair of vertices of each bit."""
    return [(u, v) for v in range(n) for u in range(v)]


def format_g6(n: int, edges) -> str:
    bits = [0] * (-(-n * (n - 1) // 12) * 6)
    for u, v in edges:
        u, v = min(u, v), max(u, v)
        bits[v * (v - 1) // 2 + u] = 1
    head = chr(n + 63) if n <= 62 else "~" + "".join(chr((n >> s & 63) + 63) for s in (12, 6, 0))
    return head + "".join(chr(63 + int("".join(map(str, bits[i : i + 6])), 2)) for i in range(0, len(bits), 6))
