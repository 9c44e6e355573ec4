"""SimHash near-dedup with an inverted index on byte positions and count filtering.

Fingerprints have eight positional bytes. Two that differ in at most four bits share at
least four of them, so a pair must reach four matches before it is verified. Postings of
single (position, byte) would give lists of a 256th of all fingerprints each, and a number
of pairs to tally that is quadratic with no relief; so the index keeps postings for triples
of them: the twenty triples of FAMILY leave no set of four positions without one of them,
and every pair that reaches the minimum meets in a posting list. In a list, shared
positional bytes are tallied for pairs and those with four or more are verified bit by bit.
Instead of its pairs a list yields the links of a spanning forest (each fingerprint to the
smallest of its group in the list), at most one per fingerprint. Lists longer than LONGEST
are divided into blocks and every two blocks are one unit of work, so no task holds an
unbounded list and no pair is lost.

Texts whose sets of five-word shingles are similar by 0.8 differ in about nine of 64 bits,
where no number of equal bytes is sure. ``similar=True`` therefore links documents by a
second signature too, through the same index: 128 positional bytes, each the last byte of
the least of all shingle hashes under one mixing, are equal with a probability of the sets'
similarity. Twelve postings of five positions each bring pairs together, shared positional
bytes are tallied over all 128, and SHARED of them make a link.

Equal fingerprints (copies) are one entry of the index, whatever their number.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from rotagraph.llm.shared import bounded, map_batches, packed, unpacked, utf8
from rotagraph.operators.components import connected
from rotagraph.session import written

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Matches that a pair within MOST_BITS is sure to reach.
LEAST_MATCHES = 8 - MOST_BITS
#: Fingerprints of a posting list that one unit of work compares; beyond, lists are cut into blocks of half of it.
LONGEST = 16384
#: Positional bytes of a sketch, those of one posting, postings, and equal bytes of a link: three quarters, so that
#: nine in ten pairs of similarity 0.8 are linked, almost all of 0.85, and hardly any below 0.65.
SKETCH, BAND, BANDS, SHARED = 128, 5, 12, 96


def covering_triples(n: int = 8) -> list[tuple[int, int, int]]:
    """Triples that hit every four of ``n`` positions, by Turan's construction: positions
    in three classes around a circle; a triple lies in one class, or has two in a class
    and one in the next."""
    of = [k * 3 // n for k in range(n)]
    out = []
    for t in combinations(range(n), 3):
        c = sorted(of[k] for k in t)
        if c[0] == c[2] or len(set(c)) == 2 and (min(c, key=c.count) - max(c, key=c.count)) % 3 == 1:
            out.append(t)
    return out


FAMILY = covering_triples()


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of the word shingles, repeats included. Words are separated by ASCII white
    space, A-Z lower-cased; fewer words than a shingle has: the whole sequence; none: empty."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """64 bits; bit b is 1 if it is set in over half the hashes of a text; without any: 0."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 65536):
        counts += np.unpackbits(hashes[lo : lo + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


#: Odd factors of the sketch's mixings, one a position.
_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(hashes: np.ndarray) -> bytes:
    """SKETCH positional bytes of the set of five-word shingles, each of which is two
    neighbouring shingles of four; of a shorter text, of its one shingle; b'' without words."""
    if not len(hashes):
        return b""
    x = hashes if len(hashes) == 1 else hashes[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    least = np.full(SKETCH, np.iinfo(np.uint64).max)
    for lo in range(0, len(x), 256):  # few enough to stay in the processor's cache
        least = np.minimum(least, (_FACTORS[:, None] * x[None, lo : lo + 256]).min(1))
    return (least ^ least >> np.uint64(32)).astype(np.uint8).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sketches: bool = False) -> DataFrame:
    """(id, text_hash, fp[, sketch]): the fingerprint of every whole text as a signed 64-bit
    integer. ``id`` and ``text_hash`` (of the text, 0 for null) tell rows of a null or repeated id apart."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), _text_hash(text).alias("text_hash"), F.col(text).alias("text"))

    def run(batch):
        fps, more = [], []
        for x in utf8(batch, "text"):
            h = shingle_hashes(x)
            fps.append(fingerprint(h))
            if sketches:
                more.append(sketch(h))
        return {"id": batch.column(0), "text_hash": batch.column(1), "fp": np.array(fps, np.uint64).view(np.int64), "sketch": more}

    return map_batches(rows, run, "id long, text_hash long, fp long" + (", sketch binary" if sketches else ""))


def _text_hash(text: str):
    return F.when(F.col(text).isNull(), F.lit(0)).otherwise(F.xxhash64(F.col(text))).cast("long")


def _postings(distinct: DataFrame) -> DataFrame:
    """(key, fp): each fingerprint once per triple of FAMILY."""

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for f, t in enumerate(FAMILY):
                key = np.full(len(fp), f, np.uint64)
                for k in t:
                    key = key << np.uint64(8) | fp >> np.uint64(8 * k) & np.uint64(255)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    return bounded(distinct).mapInArrow(run, "key long, fp long")


def _equal_bytes(x: np.ndarray) -> np.ndarray:
    """How many bytes of each 64-bit difference are zero."""
    low = np.uint64(0x7F7F7F7F7F7F7F7F)
    return 8 - np.bitwise_count(((x & low) + low | x) & ~low)


def _near(one: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of ``others`` share enough positional bytes with ``one`` and then verify."""
    x = others ^ one
    near = np.flatnonzero(_equal_bytes(x) >= LEAST_MATCHES)
    return near[np.bitwise_count(x[near]) <= MOST_BITS]


def _forest(n: int, near) -> tuple[np.ndarray, np.ndarray]:
    """(member, first member of its group) for the groups that links form within 0..n-1.
    ``near(i, others)``: places in ``others`` that i links to. What a group has reached
    leaves the search, so a dense group costs little."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        root, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            hit = near(front.pop(), left)
            if len(hit):
                got = left[hit]
                left = np.delete(left, hit)
                front += list(got)
                a.append(got)
                b.append(np.full(len(got), root))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links_of_run(keys: np.ndarray, fps: np.ndarray, sketches: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forest links (a, b), b the smaller, of consecutive posting lists: rows (key, fp) sorted
    by key. With ``sketches`` (a row of bytes each) links are by those."""
    order = np.lexsort((fps, keys))
    keys, fps = keys[order], fps[order]
    sketches = None if sketches is None else sketches[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    size = np.diff(np.concatenate((first, [len(keys)])))
    a, b = [], []
    two = first[size == 2]  # most lists that hold more than one hold two
    if len(two):
        x = fps[two] ^ fps[two + 1]
        if sketches is None:
            ok = (_equal_bytes(x) >= LEAST_MATCHES) & (np.bitwise_count(x) <= MOST_BITS)
        else:
            ok = (sketches[two] == sketches[two + 1]).sum(1) >= SHARED
        a.append(fps[two + 1][ok])
        b.append(fps[two][ok])
    for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
        own = fps[at : at + n]
        if sketches is None:
            near = lambda i, others, own=own: _near(own[i], own[others])
        else:
            near = lambda i, others, s=sketches[at : at + n]: np.flatnonzero((s[others] == s[i]).sum(1) >= SHARED)
        x, y = _forest(n, near)
        a.append(own[x])
        b.append(own[y])
    none = np.zeros(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _units(postings: DataFrame) -> DataFrame:
    """(key, unit, fp) of postings (key, fp) in lists of two or more. A list over LONGEST is cut
    into blocks; block i meets every block j: its rows go to the units (i, j) and (j, i)."""
    lists = postings.groupBy("key").count().where("count > 1")
    sizes = written(lists.select("key", F.when(F.col("count") > LONGEST, F.ceil(F.col("count") / (LONGEST // 2))).cast("int").alias("blocks")), "posting-sizes")
    both = postings.join(sizes, "key")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    unit = lambda j: F.least(mine, j) * F.col("blocks") + F.greatest(mine, j)
    units = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), unit))
    return both.select("key", F.explode(units).alias("unit"), "fp")


def _linked(units: DataFrame, held_rows: int) -> DataFrame:
    """(a, b) of the posting lists of (key, unit, fp[, sketch])."""
    by_sketch = "sketch" in units.columns

    def run(batches):
        held: list[list[np.ndarray]] = []

        def out(k, u, f, *s):
            new = np.concatenate(([True], (k[1:] != k[:-1]) | (u[1:] != u[:-1])))
            a, b = _links_of_run(np.cumsum(new), f, *s)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            k, u, f = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append([k, u, f.view(np.uint64)] + ([np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, SKETCH)] if by_sketch else []))
            if sum(len(x[0]) for x in held) < held_rows:
                continue
            k, u, *more = map(np.concatenate, zip(*held, strict=True))
            end = np.flatnonzero((k != k[-1]) | (u != u[-1]))
            cut = end[-1] + 1 if len(end) else 0  # the last list may go on
            if cut:
                yield out(*(x[:cut] for x in (k, u, *more)))
            held = [[x[cut:] for x in (k, u, *more)]]
        if sum(len(x[0]) for x in held):
            yield out(*map(np.concatenate, zip(*held, strict=True)))

    return bounded(units.repartition("key", "unit").sortWithinPartitions("key", "unit")).mapInArrow(run, "a long, b long").distinct()


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of ``distinct`` (fp), b the smaller, enough to
    connect every two that differ in at most MOST_BITS bits through such pairs."""
    return _linked(_units(_postings(distinct)), 50_000)


def similar_links(distinct: DataFrame) -> DataFrame:
    """(a, b): links between the fingerprints of ``distinct`` (fp, sketch) whose texts' sketches
    share SHARED bytes or more, of pairs that meet in a posting. Texts without words have none."""
    worded = distinct.where("length(sketch) > 0").select("fp", "sketch")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(-1, SKETCH).astype(np.uint64)
            for band in range(BANDS):
                key = np.full(len(s), band, np.uint64)
                for k in range(BAND):
                    key = key << np.uint64(8) | s[:, band * BAND + k]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    units = _units(bounded(worded).mapInArrow(run, "key long, fp long"))
    return _linked(units.join(worded, "fp").select("key", "unit", "fp", "sketch"), 20_000)


#: Stands for a null id in comparisons: after every other id.
NO_ID = (1 << 63) - 1


def _components(docs: DataFrame, id_col: str, text: str, similar: bool) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and (fp, component_id, first): for each fingerprint the
    smallest id of its component and the (id, text_hash) of the row that represents it."""
    rows = written(fingerprints(docs, id_col, text, similar), "fingerprints")
    row = F.struct(F.coalesce("id", F.lit(NO_ID)).alias("id"), "text_hash")
    more = [F.min("sketch").alias("sketch")] if similar else []
    distinct = written(rows.groupBy("fp").agg(F.min("id").alias("least"), F.min(row).alias("first"), *more), "distinct-fingerprints")
    found = links(distinct.select("fp"))
    found = connected(found.unionByName(similar_links(distinct)) if similar else found)
    member = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "first", F.coalesce("root", "fp").alias("root"))
    member = written(member, "members")
    of_root = member.groupBy("root").agg(F.min("least").alias("component_id"), F.min("first").alias("first"))
    of_root = written(of_root, "components")
    return rows, member.select("fp", "root").join(of_root, "root").select("fp", "component_id", "first")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: bool = False) -> DataFrame:
    """(id, fingerprint, component_id) for every row: the fingerprint's 16 hexadecimal
    digits and the smallest id reachable over links, the row's own included.

    Null and empty texts have the fingerprint 0 and link like others. Rows of a null id
    take part; a component of null ids only has a null id. Repeated rows each get a row.
    ``similar``: texts of similar shingle sets link too.
    """
    rows, by_fp = _components(docs, id_col, text, similar)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", similar: bool = True) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: the row of its smallest id;
    texts link by fingerprints, and by similar shingle sets unless ``similar`` is false; null ids come after all others, of equal ids the row of the smallest text hash stays,
    of equal rows one."""
    _, by_fp = _components(docs, id_col, text, similar)
    keep = by_fp.select("first.id", "first.text_hash").distinct().toDF("_keep_id", "_keep_hash")
    mine = packed(docs, _keep_id=F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)), _keep_hash=_text_hash(text))
    stay = mine.join(keep, ["_keep_id", "_keep_hash"], "left_semi")
    one = Window.partitionBy("_keep_id", "_keep_hash").orderBy("_keep_id")
    return unpacked(stay.withColumn("_nth", F.row_number().over(one)).where("_nth = 1"), docs.columns)
