"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text: densities of two lexicons (words, and beginnings of words, which
reach inflected forms that no label showed), how near their hits are to second-person
words, and the rates of capitals, punctuation and obfuscation. Both lexicons are learned
from labels: what occurs in significantly more toxic than other documents. Nothing but
the text enters a score.

Fitting uses at most SAMPLE labelled rows of each class; where that leaves rows of a class
out, those in the sample weigh as much as all labels of it, so a score means the same
probability at every size of the table. Calibration is fitted across folds, at every size:
the margin of a sampled row comes from lexicons and trees that did not see its fold.
Document frequencies of the sample are counted on the executors; the driver gets the
lexicons and a short feature vector per sampled row and fold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.functions import arrow_udf

from rotagraph.llm.shared import bounded, labelled_sample, packed, release, unpacked, utf8
from rotagraph.session import written

#: The classifier is fitted on at most so many labelled rows of each class.
SAMPLE = 3000
#: Lexicons hold at most so many entries, the most surprising; ``Lexicons.left_out`` tells how many more there were.
ENTRIES = 2000
#: Lengths in bytes of word beginnings.
BEGINNINGS = (4, 5, 6, 7, 8)
#: Folds of the calibration.
FOLDS = 5
THRESHOLD = 0.3
NEAR = 5

# Second-person words of the languages at hand, as UTF-8.
SECOND_PERSON = frozenset(
    x.encode()
    for x in "you your yours yourself yourselves u ur ya du dich dir dein deine deinen deiner deines ihr euch euer eure sie ihnen tu toi te ton ta tes vous votre vos tú ti tuyo tuya tus usted ustedes vosotros vosotras vuestro os".split()
)
FEATURES = [
    "word_density", "word_hits", "word_kinds", "beginning_density", "beginning_hits", "beginning_kinds", "second_person_density", "proximity",
    "capital_rate", "shout_rate", "mark_rate", "obfuscation_rate", "disguised_density", "n_words",
]

_FLAT = bytes(ord(chr(b).lower()) if 65 <= b < 91 else 32 if b < 128 and not chr(b).isalnum() else b for b in range(256))
_CAPITALS, _SHOUTS, _MARKS = bytes(range(65, 91)), b"!?", b".,;:'\"()-"
_OBFUSCATED = re.compile(rb"[A-Za-z][0-9@$*!|_.\-]+[A-Za-z]")
# Signs that stand for letters.
_LETTERS = bytes.maketrans(b"013457@$!|ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"oieastasiiabcdefghijklmnopqrstuvwxyz")


def _flat_words(text: bytes) -> list[bytes]:
    return text.decode("utf-8", "surrogatepass").lower().encode("utf-8", "surrogatepass").translate(_FLAT).split()


def _count(text: bytes, signs: bytes) -> int:
    return len(text) - len(text.translate(None, signs))


@dataclass
class Lexicons:
    words: frozenset = frozenset()
    beginnings: frozenset = frozenset()
    left_out: int = 0
    kinds: dict = field(default_factory=dict, repr=False)

    def kind(self, word: bytes) -> int:
        """Bits: 1 a lexicon word, 2 a lexicon beginning, 4 second person."""
        k = (word in self.words) + 4 * (word in SECOND_PERSON)
        return k + 2 * any(word[:n] in self.beginnings for n in BEGINNINGS if len(word) >= n)

    def features(self, text: bytes) -> list[float]:
        words = _flat_words(text)
        n = max(1, len(words))
        known = self.kinds
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = self.kind(w)
        kinds = np.fromiter(map(known.__getitem__, words), np.uint8, len(words))
        word_at, begin_at, second_at = (np.flatnonzero(kinds & b) for b in (1, 2, 4))
        hits = np.flatnonzero(kinds & 3)
        near = 0.0
        if len(hits) and len(second_at):
            right = np.searchsorted(second_at, hits)
            gap = np.minimum(np.abs(second_at[np.minimum(right, len(second_at) - 1)] - hits), np.abs(hits - second_at[np.maximum(right - 1, 0)]))
            near = float((gap <= NEAR).mean())
        disguised, masked = 0, 0
        if _OBFUSCATED.search(text):
            for w in text.split():
                if _OBFUSCATED.search(w):
                    masked += 1
                    disguised += w.translate(_LETTERS, b"*_.-") in self.words
        size = max(1, len(text))
        return [
            len(word_at) / n, np.log1p(len(word_at)), np.log1p(len({words[i] for i in word_at})), len(begin_at) / n, np.log1p(len(begin_at)), np.log1p(len({words[i] for i in begin_at})),
            len(second_at) / n, near, _count(text, _CAPITALS) / size, _count(text, _SHOUTS) / size, _count(text, _MARKS) / size, masked / n, disguised / n, np.log1p(len(words)),
        ]

    def __reduce__(self):
        return Lexicons, (self.words, self.beginnings, self.left_out)


def learn_lexicons(rows: DataFrame, sizes: dict[tuple[int, int], int], entries: int = ENTRIES, least: int = 4, surprise: float = 24.0, odds: float = 6.0) -> list[Lexicons]:
    """Lexicons of ``rows`` (text, y, fold) without each fold, then of all of them: words and
    beginnings found in at least ``least`` toxic rows, ``odds`` times as often as in others,
    with a log-likelihood ratio of ``surprise``; the ``entries`` most surprising of each kind.
    ``sizes``: rows by (y, fold). Terms are counted by fold in one aggregation."""
    columns = [f"{c}{f}" for f in range(FOLDS) for c in "ab"]

    def run(batches):
        for batch in batches:
            own = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("y", "fold"))
            for text, y, fold in zip(utf8(batch), *own, strict=True):
                words = set(_flat_words(text))
                heads = {w[:n] for w in words for n in BEGINNINGS if len(w) >= n}
                terms = [*(b"w" + w for w in words), *(b"b" + w for w in heads)]
                yield pa.RecordBatch.from_arrays([pa.array(terms, pa.binary()), pa.array([2 * fold + 1 - y] * len(terms), pa.int32())], names=["term", "place"])

    terms = bounded(rows.select("text", F.col("y").cast("int"), F.col("fold").cast("int"))).mapInArrow(run, "term binary, place int")
    # counts of one pass, by fold; rare terms are in no lexicon
    counts = terms.groupBy("term").agg(*[F.count(F.when(F.col("place") == k, 1)).alias(c) for k, c in enumerate(columns)])
    every_a = sum((F.col(f"a{f}") for f in range(1, FOLDS)), F.col("a0"))
    counts = written(counts.where(every_a >= least), "toxicity-terms")
    out = []
    for left in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left]
        n_toxic, n_other = (sum(sizes.get((y, f), 0) for f in folds) for y in (1, 0))
        a, b = (sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}")) for c in "ab")
        p, q = F.col("a") / F.lit(max(1, n_toxic)), (F.col("b") + 0.5) / F.lit(n_other + 1.0)
        every = (F.col("a") + F.col("b")) / F.lit(max(1, n_toxic + n_other))
        ratio = 2 * (F.col("a") * F.ln(p / every) + F.when(F.col("b") > 0, F.col("b") * F.ln(F.col("b") / F.lit(max(1, n_other)) / every)).otherwise(0.0))
        found = counts.select("term", a.alias("a"), b.alias("b")).where((F.col("a") >= least) & (p > odds * q)).withColumn("g", ratio).where(F.col("g") >= surprise)
        rank = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("g"), "term"))
        top = found.withColumn("kind", F.substring("term", 1, 1)).withColumns({"rank": rank, "all": F.count("*").over(Window.partitionBy("kind"))}).where(F.col("rank") <= entries)
        got = top.select("kind", "term", "all").collect()
        kept = [frozenset(bytes(r.term[1:]) for r in got if bytes(r.kind) == kind) for kind in (b"w", b"b")]
        out.append(Lexicons(*kept, sum({bytes(r.kind): r.all for r in got}.values()) - len(got)))
    return out


@dataclass
class Trees:
    """Boosted trees of fixed depth for the logistic loss; level by level, one split a node."""

    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), int)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(v) - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0), trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, smooth: float = 2.0, least: float = 1.0) -> Trees:
    """Second-order boosting with histograms over quantile bins. ``weights``: of a row with
    y 0, and of one with y 1. Without rows no trees."""
    w = np.where(y == 1, weights[1], weights[0])
    if not len(y):
        return Trees(np.zeros((0, 2**depth - 1), int), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)), 0.0)
    cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    prior = ((w * y).sum() + 0.5) / (w.sum() + 1)
    start = float(np.log(prior / (1 - prior)))
    margin = np.full(len(y), start)
    inner, features, thresholds, leaves = 2**depth - 1, [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        f, t = np.zeros(inner, int), np.full(inner, np.inf)
        at = np.zeros(len(y), int)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            best = 1e-9
            if len(own) > 1:
                sg, sh = g[own].sum(), h[own].sum()
                for j, c in enumerate(cuts):
                    if not len(c):
                        continue
                    lg = np.cumsum(np.bincount(binned[own, j], g[own], len(c) + 1))[:-1]
                    lh = np.cumsum(np.bincount(binned[own, j], h[own], len(c) + 1))[:-1]
                    gain = lg**2 / (lh + smooth) + (sg - lg) ** 2 / (sh - lh + smooth) - sg**2 / (sh + smooth)
                    gain[(lh < least) | (sh - lh < least)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, f[node], t[node] = gain[k], j, c[k]
            at[own] = 2 * node + 1 + (x[own, f[node]] > t[node])
        leaf = at - inner
        v = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + smooth)
        margin += v[leaf]
        features.append(f)
        thresholds.append(t)
        leaves.append(v)
    return Trees(np.array(features), np.array(thresholds), np.array(leaves), start)


def isotonic(margin: np.ndarray, y: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots (margin, probability), one a block of rows at the mean
    of its margins, kept off 0 and 1 by a twentieth of a row of each class. Between knots
    probabilities are interpolated. ``weights``: of a row with y 0, and of one with y 1.
    Without rows: one half."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # weight, positives, sum of weighted margins
    for m, v in zip(margin[order].tolist(), y[order].tolist(), strict=True):
        w = weights[int(v)]
        blocks.append([w, w * v, w * m])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            last = blocks.pop()
            blocks[-1] = [x + z for x, z in zip(blocks[-1], last, strict=True)]
    a = np.array([(m / n, (s + 0.05 * weights[1]) / (n + 0.05 * sum(weights))) for n, s, m in blocks] or [(0.0, 0.5)])
    return a[:, 0], np.maximum.accumulate(a[:, 1])


@dataclass
class ToxicityModel:
    lexicons: Lexicons
    trees: Trees
    knots: tuple[np.ndarray, np.ndarray]
    #: Whether labels of both kinds were seen.
    taught: bool = True

    def scores(self, texts: list[bytes]) -> np.ndarray:
        x = np.array([self.lexicons.features(t) for t in texts]).reshape(-1, len(FEATURES))
        return self.calibrated(self.trees.margin(x))

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, *self.knots)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep=None, sample: int = SAMPLE, entries: int = ENTRIES) -> ToxicityModel:
    """Fits on labelled rows (``keep``: a condition on their ids): lexicons and trees on all
    of them, the calibration on margins that every fifth, by hash of the id, gets from the
    others. An id with labels of both kinds counts as toxic. Without labels every score is
    one half."""
    rows = written(labelled_sample(docs, labels, "toxic", id_col, sample, keep), "toxicity-sample").withColumn("fold", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(FOLDS)).cast("int"))
    got = rows.groupBy("y", "fold").agg(F.count("*").alias("n"), F.max("weight").alias("weight")).collect()
    weight = {r.y: r.weight for r in got}
    lexicons = learn_lexicons(rows, {(r.y, r.fold): r.n for r in got}, entries)

    def run(batches):
        for batch in batches:
            texts, folds = utf8(batch), batch.column(batch.schema.get_field_index("fold")).to_pylist()
            x = [[lex.features(t) for t in texts] for lex in lexicons]
            flat = [[v for own in rows for v in own] for rows in zip(*x, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in ("_id", "y")), pa.array(folds, pa.int32()), pa.array(flat, pa.list_(pa.float64()))], names=["_id", "y", "fold", "x"])

    got = bounded(rows.select("_id", F.col("y").cast("int"), "fold", "text")).mapInArrow(run, "_id long, y int, fold int, x array<double>").collect()
    got.sort(key=lambda r: (r._id, list(r.x)))
    x = np.array([r.x for r in got]).reshape(-1, FOLDS + 1, len(FEATURES))
    y, fold = np.array([r.y for r in got], float), np.array([r.fold for r in got], int)
    weights = weight.get(0, 1.0), weight.get(1, 1.0)
    margin = np.zeros(len(y))
    for f in np.unique(fold):
        margin[fold == f] = fit_trees(x[fold != f, f], y[fold != f], weights).margin(x[fold == f, f])
    return ToxicityModel(lexicons[-1], fit_trees(x[:, -1], y, weights), isotonic(margin, y, weights), len(set(y.tolist())) == 2)


def with_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with ``score`` in 0 to 1. Null and empty texts get the score of no words;
    equal texts get equal scores; an existing column of that name is replaced."""

    @arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        kind = pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()
        scores = pa.array(model.scores([x or b"" for x in texts.cast(kind).to_pylist()]), pa.float64())
        release()
        return scores

    return bounded(docs).withColumn(score, scored(F.col(text)))


def keep_clean(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, with their columns; all of them where
    the model has not seen labels of both kinds. Null and empty texts score alike, repeated
    rows share their verdict, an empty table stays one."""
    if not model.taught:
        return docs
    scored = with_toxicity(packed(docs, _text=F.col(text)), model, "_text", "_score")
    return unpacked(scored.where(F.col("_score") < THRESHOLD), docs.columns)
