"""Quality rules: statistics of whole texts and a learned decision list over them.

Statistics and verdicts are DataFrame expressions only (native). The list is learned on
the driver from the statistics of a bounded labelled sample by sequential covering: a
conjunction of thresholds is grown by information gain on two thirds of the sample, its
last conditions are pruned on the other third, the rows it covers are removed, and the
next one follows while rules stay precise. Rows of the sample count as all labels of their
class, so a rule's precision is that of the corpus at every size. The list becomes one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from rotagraph.llm.shared import labelled_sample, packed, unpacked, words_of

WINDOW = 8
#: Base rule: too few words, or too many words (percent) in repeated windows.
LEAST_WORDS, MOST_REPEATED = 20, 30
#: The list is fitted on at most so many labelled rows of each class.
SAMPLE = 2000
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "vocabulary_growth", "capital_share", "mark_share"]


def _here(column: Column) -> Column:
    """``column``, computed where it is defined: the row number, never negative, keeps later
    filters from being pushed below, where they would repeat its expressions within each other."""
    return F.when(F.monotonically_increasing_id() >= 0, column)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds BASE counts and FEATURES to ``docs``. Null texts count as empty ones: all
    counts 0, all shares 0. Windows are compared by 64-bit hashes within one text."""
    t = F.col("_text")
    out = packed(docs, _text=F.coalesce(F.col(text), F.lit("")))
    out = out.withColumns({"_words": words_of(t), "_lines": F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    out = out.withColumns({"_hash": F.transform("_words", lambda w: F.xxhash64(w)), "n_words": F.size("_words").cast("long")})
    at = lambda i: [F.get("_hash", i + k) for k in range(WINDOW)]
    out = out.withColumn(
        "_windows",
        F.when(F.col("n_words") > WINDOW, F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*at(i)))),
    )
    doubled = F.size(F.array_distinct("_windows")) < F.size("_windows")
    out = out.withColumn("_sorted", F.when(doubled, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda j, k: F.coalesce(F.get("_sorted", j)["h"] == F.get("_sorted", j + k)["h"], F.lit(False))
    starts = F.transform(F.sequence(F.lit(0), F.size("_sorted") - 1), lambda j: F.when((j > 0) & same(j, F.lit(-1)) | same(j, F.lit(1)), F.get("_sorted", j)["i"]))
    out = out.withColumn("_starts", F.when(F.col("_sorted").isNotNull(), F.sort_array(F.filter(starts, lambda i: i.isNotNull()))))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("_starts") - 1),
        F.lit(0),
        lambda n, j: n + F.coalesce(F.least(F.lit(WINDOW), F.get("_starts", j + 1) - F.get("_starts", j)), F.lit(WINDOW)),
    )
    out = out.withColumns(
        {
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(t, F.lit(r"[#*$%&|<>]")).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_repeat_words": _here(F.when(F.col("_starts").isNotNull(), covered).otherwise(0).cast("long")),
            "_distinct": F.size(F.array_distinct("_hash")),
            "_capitals": F.regexp_count(t, F.lit("[A-Z]")),
            "_marks": F.regexp_count(t, F.lit("[.,;:!?]")),
            "_n_lines": F.size("_lines"),
        }
    )
    per = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    shares = {
        "mean_word": ("word_chars", "n_words"), "symbol_share": ("n_symbols", "word_chars"), "dup_line_share": ("n_dup_lines", "_n_lines"), "repeat_share": ("n_repeat_words", "n_words"),
        "capital_share": ("_capitals", "word_chars"), "mark_share": ("_marks", "n_words"),
    }
    out = out.withColumns({k: per(*v) for k, v in shares.items()})
    # the exponent with which the text's vocabulary grows: unlike a share of distinct words it hardly depends on length
    out = out.withColumn("vocabulary_growth", F.ln(F.greatest("_distinct", F.lit(1))) / F.ln(F.greatest("n_words", F.lit(2))))
    added = [*BASE, *(f for f in FEATURES if f not in BASE)]
    return unpacked(out, [c for c in docs.columns if c not in added], *added)


@dataclass
class DecisionList:
    """Ordered rules, each a conjunction of (feature, '<=' or '>', threshold); a row that
    meets one is rejected, the others are kept. ``trace``: precision and cover of each."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)
    trace: list[tuple[float, int]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = None
        for rule in self.rules:
            met = reduce(lambda a, b: a & b, (F.col(f) <= t if op == "<=" else F.col(f) > t for f, op, t in rule))
            out = F.when(met, True) if out is None else out.when(met, True)
        return F.lit(False) if out is None else out.otherwise(False)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(f"{f} {op} {t:.6g}" for f, op, t in r) for r in self.rules) + "\nelse keep"


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """FOIL's information gain of covering p and n instead of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _met(x: np.ndarray, rule: list) -> np.ndarray:
    out = np.ones(len(x), bool)
    for j, op, t in rule:
        out &= x[:, j] <= t if op == "<=" else x[:, j] > t
    return out


def _grow(x: np.ndarray, bad: np.ndarray, longest: int, weights: tuple[float, float]) -> list:
    rule: list = []
    inside = np.ones(len(x), bool)
    while len(rule) < longest and (~bad & inside).any():
        p0, n0 = weights[0] * int((bad & inside).sum()), weights[1] * int((~bad & inside).sum())
        best = (1e-9, None)
        for j in range(x.shape[1]):
            order = np.argsort(x[inside, j], kind="stable")
            v, b = x[inside, j][order], bad[inside][order]
            cut = np.flatnonzero(v[1:] > v[:-1])
            if not len(cut):
                continue
            p, n = weights[0] * np.cumsum(b)[cut], weights[1] * np.cumsum(~b)[cut]
            t = (v[cut] + v[cut + 1]) / 2
            for op, g in (("<=", _gain(p, n, p0, n0)), (">", _gain(p0 - p, n0 - n, p0, n0))):
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (float(g[k]), (j, op, float(t[k])))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= _met(x, [best[1]])
    return rule


def learn(x: np.ndarray, bad: np.ndarray, names: list[str], precision: float = 0.99, least: int = 5, longest: int = 4, clean_cost: float = 10.0, weights: tuple[float, float] = (1.0, 1.0)) -> DecisionList:
    """Sequential covering over rows ``x`` (their order decides grow and prune thirds).
    Pruning weighs a clean row lost as ``clean_cost`` bad rows caught. A rule must cover
    ``least`` bad rows, have at most ``longest`` conditions, reach ``precision`` on all rows left and be worth more than 0 on
    the pruning third. ``weights``: how many labelled rows a bad row, and a clean one, stand
    for; ``least`` and the cover in the trace count rows at hand. Without rows of both classes the list is empty: all are kept."""
    out = DecisionList()
    left = np.ones(len(x), bool)
    third = np.arange(len(x)) % 3 == 2
    while (bad & left).sum() >= least and (~bad).any():
        rule = _grow(x[left & ~third], bad[left & ~third], longest, weights)
        if not rule:
            break

        def worth(r: list) -> float:
            m = _met(x, r) & left & third
            p, n = weights[0] * int((bad & m).sum()), weights[1] * int((~bad & m).sum())
            return (p - clean_cost * n) / (p + n) if p + n else -clean_cost

        rule = max((rule[:k] for k in range(len(rule), 0, -1)), key=worth)
        m = _met(x, rule) & left
        p, n = int((bad & m).sum()), int((~bad & m).sum())
        precise = weights[0] * p / (weights[0] * p + weights[1] * n) if p else 0.0
        if p < least or precise < precision or worth(rule) <= 0:
            break
        out.rules.append([(names[j], op, t) for j, op, t in rule])
        out.trace.append((precise, p + n))
        left &= ~m
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", sample: int = SAMPLE) -> DecisionList:
    """Learns the list from at most ``sample`` labelled rows of each quality. Null ids and
    labels other than 0 and 1 are void, an id with both counts as good, null texts are empty.
    Without labels the list is empty."""
    rows = labelled_sample(docs, labels, "quality", id_col, sample)
    got = text_statistics(rows).select("_id", "y", "weight", *FEATURES).toPandas().sort_values("_id")
    got = got.iloc[np.random.default_rng(0).permutation(len(got))]
    weight = dict(zip(got["y"], got["weight"]))
    return learn(got[FEATURES].to_numpy(float).reshape(-1, len(FEATURES)), got["y"].to_numpy(int) == 0, FEATURES, weights=(weight.get(0, 1.0), weight.get(1, 1.0)))


def judge_quality(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """``docs`` with BASE counts, ``base_failed`` and ``kept``. Repeated rows each keep
    their verdict; columns of ``docs`` named like an added one are replaced."""
    got = text_statistics(docs.drop("base_failed", "kept"), text)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    got = got.withColumns({"base_failed": _here(failed), "kept": _here(F.when(failed, False).otherwise(~rules.rejects()))})
    return got.drop(*[f for f in FEATURES if f not in BASE])


def keep_quality(docs: DataFrame, rules: DecisionList, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with their columns. Null and empty texts have too
    few words and go; repeated rows share their verdict; an empty table stays one."""
    judged = judge_quality(packed(docs, _whole=F.col(text)), rules, "_whole")
    return unpacked(judged.where("kept"), docs.columns)
