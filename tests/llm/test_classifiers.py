import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotagraph.llm import rules, toxicity
from rotagraph.llm.shared import labelled_sample


@pytest.fixture(scope="module")
def spoken(spark):
    r = np.random.default_rng(1)
    words = ["lorem", "ipsum", "dolor", "amet", "sit", "tempor", "magna", "you", "are"]
    rows = []
    for i in range(400):
        text = " ".join(r.choice(words, 30))
        toxic = i % 3 == 0
        rows.append((i, text + (" you vile grub" if toxic else "") if i % 7 else text.upper() + "!! ### $$$ ###" * 9, int(toxic and i % 7 > 0), int(i % 7 > 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, quality int")
    return df.select("doc_id", "text"), df.select("doc_id", "toxic", "quality")


def test_toxicity_learns_and_holds_out(spoken):
    docs, labels = spoken
    model = toxicity.fit(docs, labels, keep=lambda c: F.col(c) % 4 != 2)
    got = toxicity.with_toxicity(docs, model).join(labels, "doc_id").where("doc_id % 4 = 2").collect()
    assert all((r.score >= toxicity.THRESHOLD) == (r.toxic == 1) for r in got) and all(0 <= r.score <= 1 for r in got)
    assert b"grub" in model.lexicons.words


def test_toxicity_of_odd_rows(odd, none, labels, spoken):
    model = toxicity.fit(odd, labels)
    rows = toxicity.with_toxicity(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.text in (None, "")}) == 1
    assert toxicity.with_toxicity(none, model).count() == 0
    untaught = toxicity.fit(odd, labels.limit(0))
    assert {round(r.score, 6) for r in toxicity.with_toxicity(odd, untaught).collect()} == {0.5}
    assert toxicity.keep_clean(odd, untaught).count() == odd.count()
    clash = odd.selectExpr("*", "'x' AS _score", "'y' AS _text")
    kept = toxicity.keep_clean(clash, model)
    assert kept.columns == clash.columns and kept.where("_score != 'x' OR _text != 'y'").count() == 0
    assert kept.count() == sum(r.score < toxicity.THRESHOLD for r in rows)


def test_features_equal_brute_force():
    lex = toxicity.Lexicons(frozenset([b"grub", b"vile"]), frozenset([b"scum"]))
    for text in ["", "You vile GRUB!! v1le and scummy, scum.", "vile " * 3 + "a " * 9 + "dich Gr*ub", "\u00c9t\u00e9 \u00e9t\u00e9 VOUS scumbag?"]:
        words = ["".join(c if c.isalnum() or ord(c) > 127 else " " for c in w) for w in text.lower().split()]
        words = " ".join(words).split()
        n = max(1, len(words))
        at = [i for i, w in enumerate(words) if w in ("grub", "vile")]
        heads = [i for i, w in enumerate(words) if any(w.encode()[:k] == b"scum" for k in toxicity.BEGINNINGS if len(w.encode()) >= k)]
        second = [i for i, w in enumerate(words) if w.encode() in toxicity.SECOND_PERSON]
        hits = sorted(set(at) | set(heads))
        near = sum(any(abs(i - j) <= 5 for j in second) for i in hits) / len(hits) if hits and second else 0.0
        size = max(1, len(text.encode()))
        count = lambda signs, text=text: sum(text.count(c) for c in signs)
        want = [len(at) / n, math.log(1 + len(at)), math.log(1 + len({words[i] for i in at})), len(heads) / n, math.log(1 + len(heads)), math.log(1 + len({words[i] for i in heads}))]
        want += [len(second) / n, near, count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size, count("!?") / size, count(".,;:'\"()-") / size]
        got = lex.features(text.encode())
        assert got[: len(want)] == pytest.approx(want) and got[-1] == pytest.approx(math.log(1 + len(words))), text


def test_trees_equal_a_plain_search():
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (120, 3)).astype(float)
    y = ((x[:, 0] > 2) & (x[:, 1] <= 3) | (r.random(120) < 0.1)).astype(float)
    weights, rate, smooth = (3.0, 1.0), 0.15, 2.0
    got = toxicity.fit_trees(x, y, weights, trees=4, depth=2)
    w = [weights[int(v)] for v in y]
    prior = (sum(a * b for a, b in zip(w, y, strict=True)) + 0.5) / (sum(w) + 1)
    margin = [math.log(prior / (1 - prior))] * 120

    def split(own, g, h):
        best = (1e-9, 0, math.inf)
        for j in range(3):
            for cut in sorted(set(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, 33)[1:-1]))):
                left = [i for i in own if x[i, j] <= cut]
                right = [i for i in own if x[i, j] > cut]
                a, b = ((sum(g[i] for i in part), sum(h[i] for i in part)) for part in (left, right))
                if min(a[1], b[1]) >= 1:
                    gain = a[0] ** 2 / (a[1] + smooth) + b[0] ** 2 / (b[1] + smooth) - (a[0] + b[0]) ** 2 / (a[1] + b[1] + smooth)
                    if gain > best[0] + 1e-12:
                        best = (gain, j, cut)
        return best[1:]

    for _ in range(4):
        p = [1 / (1 + math.exp(-m)) for m in margin]
        g, h = [a * (b - c) for a, b, c in zip(w, p, y, strict=True)], [a * b * (1 - b) for a, b in zip(w, p, strict=True)]
        parts = [list(range(120))]
        for _level in range(2):
            parts = [[i for i in own if (x[i, j] > t) == side] for own in parts for j, t in [split(own, g, h)] for side in (False, True)]
        for own in parts:
            value = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + smooth)
            for i in own:
                margin[i] += value
    assert got.margin(x) == pytest.approx(margin)


def test_isotonic_equals_the_best_monotone_fit():
    r = np.random.default_rng(5)
    m, y = np.sort(r.normal(size=9)), (r.random(9) < 0.5).astype(float)
    x, p = toxicity.isotonic(m, y)
    # the fit of a row by the min-max formula over means of ranges
    means = [max(min(y[i : j + 1].mean() for j in range(k, 9)) for i in range(k + 1)) for k in range(9)]
    sizes = [means.count(v) for v in sorted(set(means))]
    want = [(v * n + 0.05) / (n + 0.1) for v, n in zip(sorted(set(means)), sizes, strict=True)]
    assert p == pytest.approx(want) and x == pytest.approx([m[np.array(means) == v].mean() for v in sorted(set(means))])


def test_isotonic_is_monotone():
    r = np.random.default_rng(0)
    m = r.normal(size=200)
    x, y = toxicity.isotonic(m, (r.random(200) < 1 / (1 + np.exp(-3 * m))).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all() and 0 < y[0] < y[-1] < 1


def test_score_does_not_depend_on_the_sample_bound(spark):
    # every toxic text and three in ten of the others end in marks; one in ten is toxic
    r = np.random.default_rng(3)
    rows = []
    for i in range(4000):
        toxic = i % 10 == 0
        rows.append((i, " ".join(r.choice(["lorem", "ipsum", "dolor", "amet", "tempor"], 30)) + (" !!" if toxic or r.random() < 0.3 else ""), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int").cache()
    fixed = [x[1].encode() for x in rows if x[1].endswith("!!")][:300]
    whole, bounded = (toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), sample=n).scores(fixed).mean() for n in (4000, 400))
    assert 0.2 < whole < 0.35 and abs(whole - bounded) < 0.08


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen: dict = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_statistics_equal_brute_force(spark, odd):
    texts = ["a b c d e f g h " * 3, "x\nx\n\nx y\n", "a b c d e f g h i a b c d e f g h", " ".join("abcdefg") * 2, "#|# <>", "w " * 20, "\u00a0 \x0b a\x0cb \u2003"]
    df = odd.select("text").unionByName(spark.createDataFrame([(t,) for t in texts], "text string"))
    for r in rules.text_statistics(df).collect():
        assert brute(r.text) == tuple(r[c] for c in rules.BASE), r.text


def test_decision_list_learns(spoken):
    docs, labels = spoken
    learned = rules.fit(docs, labels)
    rows = rules.judge_quality(docs, learned).join(labels, "doc_id").collect()
    assert learned.rules and all(r.kept == (r.quality == 1 and not r.base_failed) for r in rows)
    kept = rules.keep_quality(docs, learned)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in rows)


def test_sample_has_one_row_of_an_id(spark):
    docs = spark.createDataFrame([(1, f"copy {i}") for i in range(300)] + [(2, None), (2, "two"), (3, "three")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, toxic int")
    got = [sorted(map(tuple, labelled_sample(d, labels, "toxic", "doc_id", 10).collect()), key=lambda r: r[0]) for d in (docs, docs.repartition(7))]
    assert [r[0] for r in got[0]] == [1, 2, 3] and got[0] == got[1]


def test_precision_is_that_of_all_labels(spark):
    # three in four bad texts hold signs, and 10 of 2000 clean ones, one of them within the bound
    ids = spark.range(200, 2200).orderBy(F.xxhash64("id"), "id").collect()
    marked = {r.id for rank, r in enumerate(ids) if rank % 200 == 100} | set(range(150))
    rows = [(i, "lorem ipsum dolor amet tempor " * 5 + ("### $$$" if i in marked else "magna sit"), int(i >= 200)) for i in range(2200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    for bound in (2000, 200):
        assert rules.fit(df.select("doc_id", "text"), df.select("doc_id", "quality"), sample=bound).rules == [], bound


def test_quality_of_odd_rows(odd, none, labels):
    learned = rules.fit(odd, labels)
    assert rules.keep_quality(odd, learned).columns == odd.columns
    rows = rules.judge_quality(odd, learned).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.text in (None, ""))
    assert rules.judge_quality(none, learned).count() == 0
    assert rules.fit(odd, labels.limit(0)).rules == []
