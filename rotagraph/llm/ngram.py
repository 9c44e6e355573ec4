"""LM scoring by deleted interpolation of maximum-likelihood estimates.

p(w | h) = a[k] c(h, w) / c(h) + b[k] c(w) / N + (1 - a[k] - b[k]) / (V + 1)

where k is the frequency bucket of the context h. The weights are learned by
expectation-maximisation on counts that were held out: those of the training documents of
one remainder of a second hash, which give no c while weights are learned. Scores then use
the counts of all training documents.

Counts cover the whole corpus and are exact but for collisions of hashes: words are compared
by XXH64, bigrams by 48 bits of a mix of their words' hashes and their bucket. A task reads
its documents in chunks and sends, for each chunk, its texts as word numbers and its distinct
words and bigrams as hashes with their counts, dealt into buckets by hash. A bucket's totals
are summed over all chunks and every chunk gets those of its own keys back, in their order;
a chunk's answers then meet its tokens. So a key is shuffled once per chunk that holds it,
as a few bytes of a packed row, however often it occurs, and no table of counts is ever
broadcast or collected. Held-out documents have chunks of their own (of odd numbers), so
learning the weights reads those only.

Nothing that a task holds grows with the corpus: the number of buckets follows from the
bytes of text, so that a bucket holds the keys of BUCKET bytes of it. Beyond FAN chunks,
rows of a chunk would become too small; then groups of FAN chunks are merged by SUPER
buckets first, the merged keys meet in finer buckets, and totals go back the same two steps.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.llm.shared import bounded, release, utf8
from rotagraph.session import PACKED, settings, written

#: Bytes of text in a chunk.
CHUNK = 4 << 20
#: Bytes of text whose keys one bucket holds.
BUCKET = 8 << 20
#: Chunks whose rows meet in one step, and the buckets of the first of two steps.
FAN, SUPER = 4096, 2048
#: Words have so many times fewer buckets than bigrams, as they are fewer.
FEWER = 8
#: Tokens of a chunk that are scored at once.
SLICE = 1 << 17
#: Bytes of packed tokens in one row: rows of a megabyte are hard on a Java heap.
PIECE = 1 << 18
#: Context-frequency buckets: by the number of binary digits of c(h), the last open.
FREQUENCIES = 20
#: Cells per decade of the grid of estimates on which expectation-maximisation starts.
CELLS = 16
#: Rounds of expectation-maximisation on the grid, and at most on the exact counts, which end when no weight moves more than TOLERANCE.
ROUNDS, EXACT_ROUNDS, TOLERANCE = 200, 12, 1e-4
#: Rows that a Parquet reader holds at once, as the packed rows are large.
READING = {"spark.sql.parquet.columnarReaderBatchSize": "256"}
END = b"\n"  # the end token; no word holds a line feed

ROW = "chunk long, kind int, bucket int, payload binary"
_ROW = pa.schema([("chunk", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("payload", pa.binary())])
WORDS, PAIRS, TOKENS, SUMS = 0, 1, 2, 3


@lru_cache(1)
def _codec():
    import zstandard

    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays, each with its type and length, compressed: first bytes of all numbers, then
    second ones, as the high bytes are alike."""
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes()
    return _codec()[0].compress(b"".join(x for a in arrays for x in (b"%s %d\n" % (a.dtype.str.encode(), a.nbytes), planes(a))))


def _unpack(payload: bytes) -> list[np.ndarray]:
    raw, at, out = _codec()[1].decompress(payload), 0, []
    while at < len(raw):
        end = raw.index(b"\n", at)
        kind, n = raw[at:end].split()
        size = np.dtype(kind.decode()).itemsize
        planes = np.frombuffer(raw, np.uint8, int(n), end + 1).reshape(size, -1)
        out.append(np.ascontiguousarray(planes.T).view(kind.decode()).reshape(-1))
        at = end + 1 + int(n)
    return out


def _narrow(a: np.ndarray) -> np.ndarray:
    """The smallest unsigned type that holds ``a``."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def tokens_of(text: bytes) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, then the end token."""
    return [*text.lower().split(), END]


def pair_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One 64-bit key of two hashes; the order counts."""
    x = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x165667B19E3779F9)
    return x ^ (x >> np.uint64(32))


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    """16 bits of each word's hash: those of two words give their bigram's bucket, so
    a chunk's tokens bring two bytes a word along instead of a bucket a bigram."""
    return (hashes >> np.uint64(48)).astype(np.uint16)


def _pair_bucket(left: np.ndarray, right: np.ndarray, buckets: int) -> np.ndarray:
    mixed = (left.astype(np.uint64) << np.uint64(16) | right) * np.uint64(0x9E3779B97F4A7C15)
    return _bucket(mixed, buckets)


def _columns(kind: int, keys: np.ndarray) -> tuple[np.ndarray, ...]:
    """Keys as they are packed: of bigrams 48 bits."""
    return (keys,) if kind == WORDS else (keys.astype(np.uint32), (keys >> np.uint64(32)).astype(np.uint16))


def _read(kind: int, chunk: int, payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a packed row, their counts in all training documents, and in those that are not held out."""
    parts = _unpack(payload)
    n = 1 if kind == WORDS else 2
    keys = parts[0] if kind == WORDS else parts[0] | parts[1].astype(np.uint64) << np.uint64(32)
    counts = parts[n:]
    return keys, counts[0], counts[1] if len(counts) > 1 else np.zeros_like(counts[0]) if chunk % 2 else counts[0]


@dataclass(frozen=True)
class Sizes:
    """Numbers that follow from the bytes of text: buckets of bigrams that chunks deal their
    keys into, groups of chunks (1: no merging), finer buckets a bucket, partitions."""

    buckets: int
    groups: int
    fine: int
    partitions: int

    @classmethod
    def of(cls, size: int) -> Sizes:
        wanted = max(FEWER, -(-size // BUCKET))
        groups = -(-size // (CHUNK * FAN))
        if groups <= 1:
            return cls(wanted, 1, 1, wanted)
        return cls(SUPER, groups, -(-wanted // SUPER), wanted)

    def of_kind(self, kind: int) -> int:
        return max(1, self.buckets // FEWER) if kind == WORDS else self.buckets


class Chunk:
    """Documents of one chunk as token numbers, with what they count for: documents of
    mode 0 give counts, those of mode 1 give held-out counts, those of mode 2 neither."""

    def __init__(self):
        self.numbers: dict[bytes, int] = {END: 0}
        self.ids: list = []
        self.modes: list[int] = []
        self.tokens: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, mode: int, text: bytes) -> None:
        words = tokens_of(text)
        numbers = self.numbers
        for w in set(words).difference(numbers):
            numbers[w] = len(numbers)
        self.tokens.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.modes.append(mode)
        self.size += len(text) + 64

    def rows(self, chunk: int, sizes: Sizes) -> list[tuple[int, int, int, bytes]]:
        """ROW tuples of the chunk: its keys with their counts, and its tokens."""
        import xxhash

        hashes = np.array([xxhash.xxh64_intdigest(w) for w in self.numbers], np.uint64)
        lengths = np.array([len(t) for t in self.tokens], np.int64)
        modes = np.array(self.modes, np.uint8)
        order = np.argsort(_bucket(hashes, sizes.of_kind(WORDS)), kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        end, hashes = place[0], hashes[order]
        flat = place[np.concatenate(self.tokens)]  # words are numbered by bucket from here on
        trains = np.repeat(modes, lengths) < 2
        number, left, right = _pairs(flat, end, len(hashes))
        marks = _marks(hashes)
        buckets = _bucket(hashes, sizes.of_kind(WORDS)), _pair_bucket(marks[left], marks[right], sizes.buckets)
        out = []
        for kind, own, at in ((WORDS, hashes, flat), (PAIRS, pair_keys(hashes[left], hashes[right]), number)):
            counts = np.bincount(at[trains], minlength=len(own)).astype(np.uint32)
            bucket = buckets[kind]
            order = np.argsort(bucket, kind="stable")
            columns = [c[order] for c in (*_columns(kind, own), counts)]
            cut = np.searchsorted(bucket[order], np.arange(sizes.of_kind(kind) + 1))
            out += [(chunk, kind, k, _pack(*(c[cut[k] : cut[k + 1]] for c in columns))) for k in np.unique(bucket).tolist()]
        ids = np.array([i if i is not None else 0 for i in self.ids], np.int64)
        null = np.array([i is None for i in self.ids], np.uint8)
        tokens = _pack(ids, null, modes, lengths, flat, np.array([end], np.int64), marks)
        pieces = [tokens[lo : lo + PIECE] for lo in range(0, len(tokens), PIECE)]
        return [*out, *((chunk, TOKENS, (31 * chunk + i) % (1 << 20), struct.pack(">II", i, len(pieces)) + p) for i, p in enumerate(pieces))]


def _pairs(flat: np.ndarray, end: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of each token's (context, word) among the distinct ones of ``n`` words, and
    those. The context of a document's first word is the end token."""
    before = np.concatenate((np.array([end], flat.dtype), flat[:-1]))
    pairs, number = np.unique(before.astype(np.uint64) * np.uint64(n) + flat, return_inverse=True)
    return number.reshape(-1), (pairs // np.uint64(n)).astype(np.int64), (pairs % np.uint64(n)).astype(np.int64)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), _ROW, strict=True)], schema=_ROW)


def _chunks(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """ROWs of ``docs`` (id, mode, text). Held-out documents go to chunks of odd numbers."""

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 24
        open_chunks = [Chunk(), Chunk()]

        def out(odd: int):
            nonlocal number
            rows = open_chunks[odd].rows(2 * number + odd, sizes)
            open_chunks[odd], number = Chunk(), number + 1
            release()
            return _batch(rows)

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                for doc_id, mode, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), utf8(part), strict=True):
                    odd = int(mode == 1)
                    open_chunks[odd].add(doc_id, mode, text)
                    if open_chunks[odd].size >= CHUNK:
                        yield out(odd)
        for odd in (0, 1):
            if open_chunks[odd].ids:
                yield out(odd)

    return bounded(docs).mapInArrow(run, ROW)


def _summed(kind: int, held: list[tuple[int, bytes]]):
    """Distinct keys of rows, their two totals, and for each row the places of its keys."""
    parts = [_read(kind, chunk, p) for chunk, p in held]
    distinct, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    totals = [np.bincount(place.reshape(-1), np.concatenate([p[k] for p in parts]), len(distinct)).astype(np.int64) for k in (1, 2)]
    return distinct, totals, np.split(place.reshape(-1), np.cumsum([len(p[0]) for p in parts])[:-1])


def _answer(kind: int, chunk: int, everything: np.ndarray, learning: np.ndarray) -> bytes:
    """Totals for a chunk, in the order of its keys; a held-out chunk needs the learning ones too."""
    return _pack(*map(_narrow, (everything, learning) if chunk % 2 else (everything,)))


def _by_group(f):
    """A ``mapInArrow`` function: sorted rows come to ``f(key, [(chunk, payload)])`` by
    their (kind, bucket), or (group, kind, bucket); rows of tokens pass."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):  # payloads are large: one at a time
                *key, chunk, kind, bucket, payload = (batch.column(c)[i].as_py() for c in range(batch.num_columns))
                if kind == TOKENS:
                    yield _batch([(chunk, kind, bucket, payload)])
                    continue
                key = (*key, kind, bucket)
                if key != now:
                    if held:
                        yield from f(now, held)
                        release()
                    now, held = key, []
                held.append((chunk, payload))
        if held:
            yield from f(now, held)
        held = []
        release()

    return run


def _answers(rows: DataFrame, sizes: Sizes, merged: bool = False) -> DataFrame:
    """For every row of keys the totals of its keys over all chunks, in their order (with
    the keys themselves if ``merged``); rows of tokens as they are. A row of kind SUMS
    carries a bucket's sums over its words."""

    def answer(key, held):
        kind, bucket = key
        distinct, (everything, learning), places = _summed(kind, held)
        for (chunk, payload), own in zip(held, places, strict=True):
            packed = _pack(*_columns(kind, distinct[own]), everything[own], learning[own]) if merged else _answer(kind, chunk, everything[own], learning[own])
            yield _batch([(chunk, kind, bucket, packed)])
        if kind == WORDS:
            yield _batch([(-1, SUMS, bucket, _pack(np.array([everything.sum(), (everything > 0).sum(), learning.sum(), (learning > 0).sum()], np.int64)))])

    # as many partitions as buckets of bigrams: each has one of these
    spread = F.pmod(F.when(F.col("kind") == WORDS, F.col("bucket") * FEWER).otherwise(F.col("bucket")), F.lit(sizes.partitions))
    own = rows.repartitionById(sizes.partitions, spread).sortWithinPartitions("kind", "bucket", "chunk")
    return bounded(own).mapInArrow(_by_group(answer), ROW)


def _answers_by_groups(rows: DataFrame, sizes: Sizes) -> DataFrame:
    """The same in two steps: (group of chunks, bucket) is merged into one row a finer
    bucket, whose totals come back to the group's rows."""
    rows = written(rows, "lm-keys", **PACKED)
    keys = rows.where(f"kind < {TOKENS}").select(F.pmod(F.xxhash64("chunk"), F.lit(sizes.groups)).alias("group"), "chunk", "kind", "bucket", "payload")

    def merge(key, held):
        group, kind, bucket = key
        distinct, totals, _ = _summed(kind, held)
        sub = ((distinct & np.uint64(0xFFFFFFFF)) * np.uint64(sizes.fine) >> np.uint64(32)).astype(np.int64)
        for k in np.unique(sub).tolist():
            own = sub == k
            yield _batch([(2 * (group * SUPER + bucket), kind, bucket * sizes.fine + k, _pack(*_columns(kind, distinct[own]), *(t[own] for t in totals)))])

    order = ["group", "kind", "bucket"]
    merged = bounded(keys.repartition(sizes.partitions, *order).sortWithinPartitions(*order, "chunk")).mapInArrow(_by_group(merge), ROW)
    totals = written(_answers(merged, sizes, merged=True), "lm-merged", **PACKED)
    numbers = F.expr("chunk div 2")
    back = totals.where(f"kind < {TOKENS}").select(F.expr(f"(chunk div 2) div {SUPER}").alias("group"), F.lit(-1).cast("long").alias("chunk"), "kind", (numbers % SUPER).cast("int").alias("bucket"), "payload")

    def give(key, held):
        _, kind, bucket = key
        known = [_read(kind, 0, p) for chunk, p in held if chunk < 0]  # they come first
        distinct, everything, learning = (np.concatenate([k[i] for k in known]) for i in range(3))
        order = np.argsort(distinct)
        for chunk, p in held:
            if chunk >= 0:
                at = order[np.searchsorted(distinct, _read(kind, chunk, p)[0], sorter=order)]
                yield _batch([(chunk, kind, bucket, _answer(kind, chunk, everything[at], learning[at]))])

    both = keys.unionByName(back).repartition(sizes.partitions, *order).sortWithinPartitions(*order, "chunk")
    given = bounded(both).mapInArrow(_by_group(give), ROW)
    return given.unionByName(rows.where(f"kind = {TOKENS}")).unionByName(totals.where(f"kind = {SUMS}"))


@dataclass
class Weights:
    """Mixture weights by context-frequency bucket: of bigram, word and uniform estimates."""

    a: np.ndarray
    b: np.ndarray

    def logs(self, two: np.ndarray, context: np.ndarray, one: np.ndarray, n: int, kinds: int) -> np.ndarray:
        """log10 of the mixed estimate of each token."""
        k = frequency(context)
        p2, p1, p0 = estimates(two, context, one, n, kinds)
        return np.log10(self.a[k] * p2 + self.b[k] * p1 + (1 - self.a[k] - self.b[k]) * p0)


def estimates(two: np.ndarray, context: np.ndarray, one: np.ndarray, n: int, kinds: int):
    """Bigram, word and uniform estimates of tokens."""
    return two / np.maximum(context, 1.0), one / max(n, 1), 1 / (kinds + 1)


def frequency(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else the number of binary digits of its count, at most FREQUENCIES - 1."""
    return np.minimum(np.frexp(context.astype(float))[1], FREQUENCIES - 1)


def _shares(w: np.ndarray, p: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Tokens that each of three parts explains under weights ``w``, (3, 1) or (3, tokens)."""
    part = w * p
    return part / part.sum(0) * count


def _normal(shares: np.ndarray) -> np.ndarray:
    """Weights from explained tokens; every part gets a tenth of a token more."""
    return (shares + 0.1) / (shares + 0.1).sum(-1, keepdims=True)


def start_weights(grid: list[tuple], kinds: int) -> np.ndarray:
    """(FREQUENCIES + 1, 3) by expectation-maximisation over cells of held-out tokens,
    (bucket, count, sum of bigram estimates, sum of word estimates); the last row is of all
    tokens, and stands for buckets without any."""
    g = np.array(grid, float).reshape(-1, 4)
    p = np.stack([g[:, 2] / g[:, 1], g[:, 3] / g[:, 1], np.full(len(g), 1 / (kinds + 1))])

    def fit(rows: np.ndarray) -> np.ndarray:
        w = np.full(3, 1 / 3)
        for _ in range(ROUNDS):
            w = _normal(_shares(w[:, None], p[:, rows], g[rows, 1]).sum(1))
        return w

    everything = fit(np.arange(len(g)))
    return np.stack([fit(own) if len(own := np.flatnonzero(g[:, 0] == k)) else everything for k in range(FREQUENCIES)] + [everything])


def _learned(held: DataFrame, n: int, kinds: int) -> Weights:
    """Weights from the packed counts of held-out tokens: expectation-maximisation on a grid
    first, then on the exact counts, one aggregation a round."""

    def tokens(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                two, context, one = _unpack(batch.column(0)[i].as_py())
                p2, p1, p0 = estimates(two, context, one, n, kinds)
                yield frequency(context), np.stack([p2, p1, np.full(len(two), p0)])

    def cells(batches):
        cell = lambda p: np.where(p > 0, np.floor(-np.log10(np.maximum(p, 1e-300)) * CELLS), -1).astype(np.int64) + 1
        for k, p in tokens(batches):
            code = (k.astype(np.int64) * 10_000 + cell(p[0])) * 10_000 + cell(p[1])
            found, at = np.unique(code, return_inverse=True)
            sums = [np.bincount(at.reshape(-1), x) for x in (np.ones(len(k)), p[0], p[1])]
            yield pa.RecordBatch.from_arrays([pa.array(found // 10**8), pa.array(found), *map(pa.array, sums)], names=["k", "cell", "n", "two", "one"])

    # at most FREQUENCIES times a few hundred cells squared come to the driver: a bound that no corpus exceeds
    grid = held.mapInArrow(cells, "k long, cell long, n double, two double, one double").groupBy("k", "cell").agg(F.sum("n"), F.sum("two"), F.sum("one"))
    w = start_weights(sorted((r[0], *r[2:]) for r in grid.collect()), kinds)
    for _ in range(EXACT_ROUNDS):

        def shares(batches, w=w):
            for k, p in tokens(batches):
                own, every = _shares(w[k].T, p, 1.0), _shares(w[-1:].T, p, 1.0).sum(1)
                sums = [np.append(np.bincount(k, own[j], FREQUENCIES), every[j]) for j in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(FREQUENCIES + 1)), *map(pa.array, sums)], names=["k", "two", "one", "none"])

        rows = held.mapInArrow(shares, "k long, two double, one double, none double").groupBy("k").agg(F.sum("two"), F.sum("one"), F.sum("none")).collect()
        new = np.zeros((FREQUENCIES + 1, 3))
        for k, *x in rows:  # one row a bucket
            new[k] = x
        new = np.where(new.sum(1, keepdims=True) > 0, _normal(new), _normal(new[-1:]))
        moved, w = np.abs(new - w).max(), new
        if moved <= TOLERANCE:
            break
    w = w[:-1]
    w[0] = [0.0, w[0][1] + w[0][0] / 2, w[0][2] + w[0][0] / 2]  # no bigram estimate without a context
    return Weights(w[:, 0], w[:, 1])


def _assembled(rows: DataFrame, sizes: Sizes, f, schema: str, learning: bool) -> DataFrame:
    """Brings the answers of each chunk to its tokens and yields batches of ``f(ids, null,
    lengths, c(h,w), c(h), c(w))``, of some documents at once. ``learning``: counts without
    the held-out ones, for chunks of these only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    which = int(learning)

    def one(held: dict, payload: bytes):
        ids, null, _, lengths, flat, (end,), marks = _unpack(payload)
        words, answered = (np.concatenate([x[which] for x in held[kind]]) for kind in (WORDS, PAIRS))
        number, left, right = _pairs(flat, end, len(marks))
        twos = np.empty(len(answered), answered.dtype)
        twos[np.argsort(_pair_bucket(marks[left], marks[right], sizes.buckets), kind="stable")] = answered
        before = np.concatenate((np.array([end], flat.dtype), flat[:-1]))
        ends = np.cumsum(lengths)
        lo = 0
        while lo < len(lengths):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + SLICE)))
            own = slice(int(ends[lo] - lengths[lo]), int(ends[hi - 1]))
            columns = f(ids[lo:hi], null[lo:hi], lengths[lo:hi], twos[number[own]], words[before[own]], words[flat[own]])
            yield pa.RecordBatch.from_arrays([pa.array(c, type=x.type) for c, x in zip(columns, arrow, strict=True)], schema=arrow)
            lo = hi

    def run(batches):
        now, held, pieces = None, {}, {}
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, kind, payload = batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), batch.column(3)[i].as_py()
                if chunk != now:
                    now, held, pieces = chunk, {WORDS: [], PAIRS: []}, {}
                if kind == TOKENS:  # after all keys of its chunk
                    place, total = struct.unpack(">II", payload[:8])
                    pieces[place] = payload[8:]
                    if len(pieces) == total:
                        yield from one(held, b"".join(pieces[i] for i in range(total)))
                        held, pieces = {WORDS: [], PAIRS: []}, {}
                        release()
                else:
                    held[kind].append(_unpack(payload))

    own = rows.where(f"kind < {SUMS}" + (" AND chunk % 2 = 1" if learning else ""))
    return bounded(own.repartition(sizes.partitions, "chunk").sortWithinPartitions("chunk", "kind", "bucket")).mapInArrow(run, schema)


def score(docs: DataFrame, learns, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    ``learns``: a condition on rows; those that meet it are the training documents. Of
    these, the ones whose XXH64 of the id is 0 mod 8 are held out while the weights are
    learned; scores use the counts of all of them.
    ``base_score`` is the sum of log10((c + 1) / (N + 1 * (V + 1))) over tokens, ``score``
    that of the mixture; ``n_known`` counts tokens with c > 0. Null texts are empty: they
    have the end token only. Null ids and repeated rows each keep a row; without training
    documents N and V are 0. Other columns are not read. The scores are a written table.
    """
    spark = docs.sparkSession
    held_out = F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(8)) == 0
    mode = F.when(~F.coalesce(learns, F.lit(False)), 2).when(held_out, 1).otherwise(0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), mode.cast("int").alias("mode"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    sizes = Sizes.of(size)
    with settings(spark, READING):
        chunks = _chunks(rows, sizes)
        table = written(_answers(chunks, sizes) if sizes.groups == 1 else _answers_by_groups(chunks, sizes), "lm-counts", **PACKED)

        def unpacked(batches):
            for batch in batches:
                got = [_unpack(x)[0].tolist() for x in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in got], pa.int64()) for k in range(4)], names=["n", "kinds", "n_learning", "kinds_learning"])

        sums = table.where(f"kind = {SUMS}").select("payload").mapInArrow(unpacked, "n long, kinds long, n_learning long, kinds_learning long")
        n, kinds, n_learning, kinds_learning = (x or 0 for x in sums.agg(*(F.sum(c) for c in sums.columns)).first())

        def counts(ids, null, lengths, two, context, one):
            return [[_pack(_narrow(two), _narrow(context), _narrow(one))]]

        held = written(_assembled(table, sizes, counts, "payload binary", True), "lm-held-out", **PACKED)
        weights = _learned(bounded(held), n_learning, kinds_learning)

        def scored(ids, null, lengths, two, context, one):
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            total = lambda x: np.add.reduceat(x, starts)
            plain = np.log10((one.astype(float) + 1) / (n + (kinds + 1)))
            mixed = weights.logs(two.astype(float), context.astype(float), one.astype(float), n, kinds)
            return [pa.array(ids, mask=null.astype(bool)), lengths, total((one > 0).astype(np.int64)), np.full(len(ids), n), total(plain), total(mixed)]

        schema = f"{id_col} long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        out = written(_assembled(table, sizes, scored, schema, False), "lm-scores")
    return out
