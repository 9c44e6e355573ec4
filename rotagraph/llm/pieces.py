"""Piece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The pieces of a sentencepiece model are the patterns of one automaton. It reads a text
once; at each position the output links lead from the longest piece that ends there to
every shorter one, and each of them relaxes the best score of that position. What no
piece covers becomes one unknown character, spelt out in byte pieces where the model has
them. Scores: those of the model; user-defined pieces take precedence by length, as the
library's unigram models do.

No piece of a whitespace-prefix vocabulary holds the space mark after another character,
so the best path of a text is that of its words (space mark included), and a word's path
is found once per worker and remembered. Models of other vocabularies run uncut.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rotagraph.llm.shared import bounded

MARK = "▁"
#: Words whose path a worker remembers, and the longest such word.
REMEMBERED, LONGEST = 300_000, 64


class PieceModel:
    """Pieces and scores of a model file, with the automaton over its pieces."""

    def __init__(self, path: str | None = None, proto=None):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            proto = pb.ModelProto()
            with open(path, "rb") as f:
                proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix
        if proto.normalizer_spec.precompiled_charsmap or proto.normalizer_spec.remove_extra_whitespaces or not proto.normalizer_spec.escape_whitespaces:
            raise ValueError("only models with identity normalisation and escaped spaces are supported")
        self.pieces = [p.piece for p in proto.pieces]
        normal = [p.score for p in proto.pieces if p.type == kinds.NORMAL]
        most, self.unknown_score = max(normal), min(normal) - 10.0
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        shown = {kinds.CONTROL: "", kinds.UNKNOWN: " \u2047 "}
        #: The bytes that each id stands for.
        self.bytes_of = [bytes([self.byte_of[i]]) if i in self.byte_of else shown.get(p.type, p.piece).replace(MARK, " ").encode() for i, p in enumerate(proto.pieces)]
        self.table = pa.array(self.bytes_of, pa.binary())
        self.automaton = ahocorasick.Automaton()
        self.cuttable = True
        for i, p in enumerate(proto.pieces):
            if p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                score = p.score if p.type == kinds.NORMAL else len(p.piece) * most - 0.1
                self.automaton.add_word(p.piece, (i, len(p.piece), score))
                self.cuttable &= not re.search(f"[^{MARK}]{MARK}", p.piece)
        self.automaton.make_automaton()
        self.known: dict[str, bytes] = {}  # by the word after one mark
        self.known_runs: dict[str, bytes] = {}  # by the word with its marks

    def viterbi(self, text: str) -> list[int]:
        """Ids of the best path through ``text`` (space marks in place). Of equal scores the
        longer last piece stays, as the longer outputs come first."""
        n = len(text)
        best = [0.0] * (n + 1)
        came: list = [None] * (n + 1)
        done = 0  # positions up to here are final
        low = self.unknown_score

        def close(upto: int) -> None:
            """Finishes the positions up to ``upto``: one unknown character may lead there."""
            nonlocal done
            while done < upto:
                done += 1
                s = best[done - 1] + low
                if came[done] is None or s > best[done]:
                    best[done], came[done] = s, (-1, 1)

        for end, (i, size, score) in self.automaton.iter(text):
            end += 1
            if end - 1 > done:
                close(end - 1)
            s = best[end - size] + score
            if came[end] is None or s > best[end]:
                best[end], came[end] = s, (i, size)
        close(n)
        out: list[int] = []
        while n:
            i, size = came[n]
            if i < 0:
                raw = text[n - 1 : n].encode("utf-8", "surrogatepass")
                out += [self.byte_ids[b] for b in reversed(raw)] if self.byte_ids else [self.unknown]
            else:
                out.append(i)
            n -= size
        return out[::-1]

    def prepared(self, text: str) -> str:
        return ((" " if self.dummy_prefix and text else "") + text).replace(" ", MARK)

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; '' gives none."""
        text = self.prepared(text)
        if not self.cuttable:
            return np.array(self.viterbi(text), np.int32)
        # a run of marks belongs to the word after it; without runs a plain split does
        runs = MARK + MARK in text or text[-1:] == MARK
        first, *words = ["", *re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", text)] if runs else text.split(MARK)
        known = self.known if not runs else self.known_runs
        if len(known) > REMEMBERED:
            known.clear()
        mark = "" if runs else MARK
        new = {w: np.array(self.viterbi(mark + w), np.int32).tobytes() for w in set(words).difference(known)}
        known.update((w, ids) for w, ids in new.items() if len(w) <= LONGEST)
        head = np.array(self.viterbi(first), np.int32).tobytes()
        return np.frombuffer(head + b"".join([known[w] if w in known else new[w] for w in words]), np.int32)

    def decode(self, ids) -> str | None:
        """The text of ids: marks become spaces, byte pieces join, the prefix space goes. What
        is not UTF-8 then becomes U+FFFD. None if an id is not of the model."""
        return self.decode_lists(pa.array([list(map(int, ids))], pa.list_(pa.int32())))[0]

    def decode_lists(self, lists: pa.Array) -> list[str | None]:
        """The texts of many lists of ids at once; of a null list, and of one with a null, None."""
        import pyarrow.compute as pc

        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(counts)
        ids = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
        strange = (ids < 0) | (ids >= len(self.bytes_of))
        until = np.concatenate(([0], np.cumsum(strange)))
        taken = self.table.take(pa.array(np.where(strange, 0, ids)))
        at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1).tolist()
        raw = memoryview(taken.buffers()[2] or b"")
        out: list[str | None] = []
        for n, end, known in zip(counts.tolist(), ends.tolist(), lists.is_valid().to_pylist(), strict=True):
            if not known or until[end] > until[end - n]:
                out.append(None)
                continue
            lo, hi = at[end - n], at[end]
            out.append(str(raw[lo + (self.dummy_prefix and hi > lo and raw[lo] == 32) : hi], "utf-8", "replace"))
        return out


_models: dict[str, PieceModel] = {}


def model_of(path: str) -> PieceModel:
    """One model per worker process."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _mapped(df: DataFrame, column: str, kept: list[str], added: str, f) -> DataFrame:
    """Columns ``kept`` of ``df`` and those of ``f(values of column)``, 512 rows at once."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType([df.schema[c] for c in kept] + StructType.fromDDL(added).fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                columns = [part.column(k).cast(arrow.field(k).type) for k in range(len(kept))]
                more = [x.cast(arrow.field(len(kept) + k).type) for k, x in enumerate(f(part.column(len(kept))))]
                yield pa.RecordBatch.from_arrays([*columns, *more], schema=arrow)

    return bounded(df.select(*[F.col(f"`{c}`") for c in kept], F.col(column).alias("_given"))).mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", keep_text: bool = False) -> DataFrame:
    """``docs`` (without ``text`` unless ``keep_text``) with ``ids`` (array of int) and
    ``n_pieces``. Null texts count as empty and give no ids. Rows are independent: repeated
    rows, nulls elsewhere and an empty table pass through. Columns of ``docs`` named like an
    added one are replaced."""

    def run(texts: pa.Array):
        m = model_of(model)
        ids = [m.encode(t or "") for t in texts.to_pylist()]
        counts = np.array([len(x) for x in ids], np.int64)
        offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids))), pa.array(counts)

    gone = {"ids", "n_pieces"} | (set() if keep_text else {text})
    return _mapped(docs, text, [c for c in docs.columns if c not in gone], "ids array<int>, n_pieces long", run)


def decode_pieces(rows: DataFrame, model: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """``rows`` with ``into``: the text of ``ids``. Null where ``ids`` is null, holds a null or
    an id that the model lacks; no ids give ''. Texts that held the space mark itself have
    spaces there. A column of ``rows`` of that name is replaced."""

    def run(lists: pa.Array):
        return (pa.array(model_of(model).decode_lists(lists), pa.string()),)

    return _mapped(rows, ids, [c for c in rows.columns if c != into], f"`{into}` string", run)
