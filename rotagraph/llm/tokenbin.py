"""Token-ID output: Arrow stream-files of fixed-size-list batches.

Each shard holds the ids of consecutive documents in ascending id order, cut into
sequences of equal length: a record batch has the columns ``ids`` (fixed-size list of
unsigned 16 or 32-bit integers) and ``mask`` (fixed-size list of bits: 1 where an id
stands, 0 in the padding of the last sequence). The file format keeps the batches'
offsets in its footer, so a memory-mapped shard gives any sequence without a copy. A
second file per shard keeps (id, start, n) of its documents.

Documents are range-partitioned by id, each partition writes one shard under a name of
its own attempt and reports it in a manifest row; the manifest is written as a table, so
what a lost task left behind is never read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.llm.shared import bounded
from rotagraph.session import fresh_path, written

#: Ids per sequence, sequences per record batch.
SEQUENCE, BATCH = 2048, 64
#: Ids that are read back together.
AT_ONCE = 1 << 22
#: Segments whose ids a worker remembers: those met once of late, and those met again.
YOUNG, REMEMBERED = 150_000, 400_000

INDEX = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
MANIFEST = "shard int, ids_uri string, index_uri string, n_docs long, n_ids long"


CLOSING = ".,;:!?"
#: A space that no visible character follows.
APART = re.compile(r" (?:\s|\Z)")
ID = attrgetter("id")


class SegmentEncoder:
    """Encodes texts with a byte-level BPE of the tokenizers library, once per segment.

    The pre-tokenizer of such a vocabulary starts a new pre-token at each single space
    that a visible character follows, so a text is the concatenation of segments cut
    there, and so are its ids. New segments go to the library in long runs, which are
    texts of the same kind; the bytes that each id stands for tell where a segment ends.

    Strings of added tokens in a text are ordinary text, or with ``special`` become their
    ids, as in a plain call of the library; texts that hold one are then encoded whole.
    """

    #: Characters of new segments that are encoded as one text.
    RUN = 8192

    def __init__(self, path: str, special: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.size = self.tokenizer.get_vocab_size()
        # a token of a byte-level vocabulary has one character for each byte
        self.bytes_of = np.zeros(self.size, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.dtype = np.dtype(np.uint16 if self.size < 1 << 16 else np.uint32)
        plain = [b for b in range(256) if 33 <= b < 127 or 161 <= b < 173 or b > 173]
        shown = dict(zip(plain, plain, strict=True)) | {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.letters = shown  # the character that stands for each byte in such a vocabulary
        self.closing: dict[str, bytes] = {}
        self.firsts: dict[str, bytes] = {}  # the ids of a text's first segment
        self.young: dict[str, bytes] = {}
        self.known: dict[str, bytes] = {}  # the ids of a space and the segment that follows it

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for lo in range(0, len(texts), 16):  # the library's results are large until read
            out += [np.array(x.ids, self.dtype) for x in self.tokenizer.encode_batch_fast(texts[lo : lo + 16], add_special_tokens=False)]
        return out

    def _special_ids(self, texts: list[str]) -> list[np.ndarray]:
        self.tokenizer.encode_special_tokens = False
        try:
            return self._ids(texts)
        finally:
            self.tokenizer.encode_special_tokens = True

    def _learn(self, segments: Iterable[str]) -> None:
        """New segments. Letters are one pre-token, which the library's model takes as it
        is, and closing punctuation after them is another; the rest is encoded in runs."""
        young, closing, tokenize = self.young, self.closing, self.tokenizer.model.tokenize
        rest, letters, tails = [], [], []
        for s in segments:
            if s.isalpha():
                letters.append(s)
                continue
            core = s.rstrip(CLOSING)
            if core.isalpha():
                tails.append((s, core))
                if core not in young:
                    letters.append(core)
            else:
                rest.append(s)
        ids: list[int] = []
        ends: list[int] = []
        for s in letters:
            ids += map(ID, tokenize("\u0120" + (s if s.isascii() else s.encode().decode("latin-1").translate(self.letters))))
            ends.append(len(ids))
        self._keep(letters, np.array(ids, self.dtype), ends)
        for s, core in tails:
            tail = s[len(core) :]
            if tail not in closing:
                closing[tail] = self._ids([tail])[0].tobytes()
            young[s] = young[core] + closing[tail]
        self._learn_runs(rest)

    def _keep(self, segments: list[str], ids: np.ndarray, ends: list[int]) -> None:
        raw, width, lo = ids.tobytes(), self.dtype.itemsize, 0
        for s, end in zip(segments, ends, strict=True):
            hi = end * width
            self.young[s] = raw[lo:hi]
            lo = hi

    def _learn_runs(self, segments: list[str]) -> None:
        run: list[str] = []
        held = 0
        for s in segments:
            run.append(s)
            held += len(s)
            if held > self.RUN:
                self._learn_run(run)
                run, held = [], 0
        if run:
            self._learn_run(run)

    def _learn_run(self, run: list[str]) -> None:
        ids = self._ids([" " + " ".join(run)])[0]
        ends = np.cumsum(np.fromiter(map(len, map(str.encode, run)), np.int64, len(run)) + 1)
        at = np.cumsum(self.bytes_of[ids])
        cut = np.searchsorted(at, ends, "right")
        if len(at) and not np.array_equal(at[cut - 1], ends):
            raise ValueError("a token crosses two segments: not a byte-level vocabulary")
        self._keep(run, ids, cut.tolist())

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        known, young = self.known, self.young
        if len(known) > REMEMBERED:
            known.clear()
        if len(young) > YOUNG:
            young.clear()
        parts, gaps = [], []
        held = [k for k, text in enumerate(texts) if any(a in text for a in self.added)]
        apart = dict(zip(held, self._special_ids([texts[k] for k in held]), strict=True))
        # a segment that is empty or starts with white space depends on what stands before it
        whole = [k for k, text in enumerate(texts) if k not in apart and (text[:1].isspace() or APART.search(text))]
        plain = apart | dict(zip(whole, self._ids([texts[k] for k in whole]), strict=True))
        for k, text in enumerate(texts):
            if k in plain:
                parts.append(None)
                continue
            first, *segments = text.split(" ")
            got = list(map(known.get, segments))
            parts.append((first, got))
            if None in got:
                for i, x in enumerate(got):
                    if x is None:
                        s = segments[i]
                        if s in young:
                            got[i] = known[s] = young.pop(s)
                        else:
                            gaps.append((got, i, s))
        self._learn(dict.fromkeys(s for _, _, s in gaps))
        for got, i, s in gaps:
            got[i] = young[s]
        firsts = self.firsts
        if len(firsts) > YOUNG:
            firsts.clear()
        unseen = list({p[0] for p in parts if p}.difference(firsts))
        firsts.update(zip(unseen, (x.tobytes() for x in self._ids(unseen)), strict=True))
        return [plain[k] if p is None else np.frombuffer(firsts[p[0]] + b"".join(p[1]), self.dtype) for k, p in enumerate(parts)]


_encoders: dict[tuple[str, bool], SegmentEncoder] = {}


def encoder_of(path: str, special: bool = False) -> SegmentEncoder:
    """One encoder per worker process: its vocabulary is read and its segments are learned once."""
    if (path, special) not in _encoders:
        _encoders[path, special] = SegmentEncoder(path, special)
    return _encoders[path, special]


class ShardWriter:
    """One shard: ids in order, cut into sequences, written batch by batch."""

    def __init__(self, sink, dtype, sequence: int = SEQUENCE, batch: int = BATCH):
        self.dtype, self.sequence, self.batch = np.dtype(dtype), sequence, batch
        kind = pa.list_(pa.from_numpy_dtype(self.dtype), sequence)
        self.schema = pa.schema([("ids", kind), ("mask", pa.list_(pa.bool_(), sequence))])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.waiting: list[np.ndarray] = []
        self.held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.held += len(ids)
        self.n += len(ids)
        if self.held >= self.sequence * self.batch:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        flat = np.concatenate(self.waiting or [np.zeros(0, self.dtype)])
        full = self.sequence * self.batch
        while len(flat) >= full or last and len(flat):
            part, flat = flat[:full], flat[full:]
            rows = -(-len(part) // self.sequence)
            ids = np.zeros(rows * self.sequence, self.dtype)
            ids[: len(part)] = part
            mask = np.arange(len(ids)) < len(part)
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.sequence) for x in (ids, mask)]
            self.writer.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))
        self.waiting, self.held = [flat], len(flat)

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


class ShardReader:
    """Random access to a shard: sequence ``i`` with its mask, or any range of ids."""

    def __init__(self, source, batch: int = BATCH):
        self.file, self.batch = pa.ipc.open_file(source), batch
        self.sequence = self.file.schema.field("ids").type.list_size
        self.at, self.cached = -1, None

    def _batch(self, k: int) -> pa.RecordBatch:
        if k != self.at:
            self.at, self.cached = k, self.file.get_batch(k)
        return self.cached

    def sequence_at(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        b = self._batch(i // self.batch)
        lo = i % self.batch * self.sequence
        ids, mask = (b.column(c).values[lo : lo + self.sequence] for c in (0, 1))
        return ids.to_numpy(zero_copy_only=True), mask.to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        size, out = self.sequence * self.batch, []
        while n:
            b = self._batch(start // size)
            part = b.column(0).values[start % size : start % size + n].to_numpy(zero_copy_only=True)
            out.append(part)
            start, n = start + len(part), n - len(part)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


def _open(uri: str, write: bool):
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    if write:
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(path)
    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def write_token_shards(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, special: bool = False) -> DataFrame:
    """Writes the shards below the shared ``folder``; returns the manifest (MANIFEST), one
    row per shard, in ascending ``shard`` order of their documents.

    Order: ascending ``id_col``, nulls first, then by a hash of the text, so repeated ids
    have a defined place. Null texts are empty. An empty table gives no shard. Other columns are unread.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    # the driver samples the range keys, so they are short: a hash stands for the text
    rows = rows.withColumn("hash", F.xxhash64("text")).repartitionByRange("id", "hash").sortWithinPartitions("id", "hash").select("id", "text")

    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get()
        encoder, writer, index = None, None, None
        n_docs = 0
        base = f"{folder}/shard-{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                if writer is None:
                    encoder = encoder_of(tokenizer, special)
                    dtype = np.uint16 if max(encoder.size, end_id + 1) <= 1 << 16 else np.uint32
                    end = np.array([end_id], dtype)
                    writer = ShardWriter(sink := _open(base + ".arrow", True), dtype, sequence)
                    kept = _open(base + ".index.arrow", True)
                    index = pa.ipc.new_file(kept, INDEX)
                starts, counts = [], []
                for ids in encoder.encode(part.column(1).to_pylist()):
                    starts.append(writer.n)
                    counts.append(len(ids) + 1)
                    writer.add(np.asarray(ids, writer.dtype))
                    writer.add(end)
                index.write_batch(pa.RecordBatch.from_arrays([part.column(0), pa.array(starts, pa.int64()), pa.array(counts, pa.int64())], schema=INDEX))
                n_docs += part.num_rows
        if writer is not None:
            writer.close()
            index.close()
            sink.close()
            kept.close()
            yield pa.RecordBatch.from_pylist([{"shard": task.partitionId(), "ids_uri": base + ".arrow", "index_uri": base + ".index.arrow", "n_docs": n_docs, "n_ids": writer.n}], schema=pa.schema([("shard", pa.int32()), ("ids_uri", pa.string()), ("index_uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    return written(bounded(rows).mapInArrow(run, MANIFEST), "token-manifest")


def read_token_shards(manifest: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, read from the shards' files:
    ``start`` counts the ids of all documents before it, ``ids_crc32`` is the unsigned
    crc32 of its ids as little-endian unsigned 32-bit integers."""
    # one row of figures per shard comes to the driver, no document's
    counts = manifest.select("shard", "n_ids").orderBy("shard").collect()
    before, total = {}, 0
    for r in counts:
        before[r.shard], total = total, total + r.n_ids
    schema = f"{id_col} long, start long, n_tokens long, ids_crc32 long"
    if not counts:
        return manifest.sparkSession.createDataFrame([], schema)
    spark = manifest.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "shard int, before long")
    rows = manifest.join(offsets, "shard").select("ids_uri", "index_uri", "before").repartition(min(len(counts), 4096), "ids_uri")

    def run(batches):
        arrow = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                with _open(row["ids_uri"], False) as a, _open(row["index_uri"], False) as b:
                    reader, index = ShardReader(a), pa.ipc.open_file(b)
                    for k in range(index.num_record_batches):
                        part = index.get_batch(k)
                        starts, counts = part.column(1).to_pylist(), part.column(2).to_pylist()
                        # the documents of an index batch are consecutive: one range of ids
                        if sum(counts) <= AT_ONCE:
                            raw = memoryview(reader.ids(starts[0], sum(counts)).astype("<u4").tobytes())
                            crcs = [zlib.crc32(raw[4 * (s - starts[0]) : 4 * (s - starts[0] + n)]) for s, n in zip(starts, counts, strict=True)]
                        else:
                            crcs = [zlib.crc32(reader.ids(s, n).astype("<u4").tobytes()) for s, n in zip(starts, counts, strict=True)]
                        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([row["before"] + s for s in starts], pa.int64()), part.column(2), pa.array(crcs, pa.int64())], schema=arrow)

    return bounded(rows).mapInArrow(run, schema)


def encode_to_shards(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", special: bool = False) -> DataFrame:
    """Writes ``docs`` as shards into the shared folder and reads the documents back.
    ``special``: strings of added tokens become their ids."""
    folder = fresh_path(docs.sparkSession, "token-shards")
    return read_token_shards(write_token_shards(docs, tokenizer, end_id, folder, id_col, special=special), id_col)
