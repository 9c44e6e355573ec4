import os
import re
from collections import Counter

import pytest
import xxhash

SF = "/root/testdata/sf0.001"


def words_of(text):
    """Words of a text, A-Z lower-cased."""
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, n):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))] if w else []


def fingerprint(text):
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles(text, 4)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(n, linked):
    """The least member of each of ``n`` rows' groups."""
    least = list(range(n))
    for i in range(n):
        for j in range(i):
            if linked(i, j) and least[i] != least[j]:
                a, b = sorted((least[i], least[j]))
                least = [a if x == b else x for x in least]
    return least


def rows_of(df):
    return Counter(tuple(r[c] for c in df.columns) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_stages_agree_with_their_operators(spark):
    import corpus_pipeline as p
    from rotagraph.llm import mixing, pieces, rules, simhash, toxicity
    from rotagraph.llm.queries import tokenizer_path
    from rotagraph.session import table, written

    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    columns = docs.columns
    for name, stage in p.STAGES:
        got = written(stage(spark, docs, SF), "test-stage")
        before = {r.doc_id: r for r in docs.collect()}
        after = [r.doc_id for r in got.select("doc_id").collect()]
        if name == "toxicity":
            model = toxicity.fit(docs, labels)
            assert set(after) == {i for i, r in before.items() if model.scores([r.text.encode()])[0] < toxicity.THRESHOLD}
        elif name == "quality rules":
            assert set(after) == {r.doc_id for r in rules.judge_quality(docs, rules.fit(docs, labels)).where("kept").collect()}
        elif name == "near-dedup":
            assert sorted(after) == sorted({r.component_id for r in simhash.near_duplicates(docs, similar=True).collect()})
        elif name == "mixing":
            assert set(after) == set(before)
            given = mixing.mix(docs, most_repeats=p.MOST_REPEATS)[1]
            assert sorted(after) == sorted(r.id for r in given.collect())
        else:
            model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"))
            assert len(after) == docs.count() and all(model.decode(r["ids"]) == before[r.doc_id].text for r in got.collect())
        if name != "piece encoding":
            assert got.columns == columns
        docs = got


def test_missing_labels_and_documents(spark, tmp_path):
    import corpus_pipeline as p

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_lies_between_plain_groups(spark):
    """All pairs by hand: what must be linked is, and nothing that is not similar."""
    import corpus_pipeline as p
    from rotagraph.session import table

    if not os.path.isdir(SF):
        pytest.skip("no test data")
    docs = table(spark, SF, "documents")
    rows = sorted(docs.select("doc_id", "text").collect())
    prints, sets = [fingerprint(r.text) for r in rows], [set(shingles(r.text, 5)) for r in rows]
    near = [[(prints[i] ^ prints[j]).bit_count() <= 4 for j in range(i)] for i in range(len(rows))]
    alike = [[len(sets[i] & sets[j]) / max(1, len(sets[i] | sets[j])) for j in range(i)] for i in range(len(rows))]
    sure = groups(len(rows), lambda i, j: near[i][j] or alike[i][j] >= 0.8)
    most = groups(len(rows), lambda i, j: near[i][j] or alike[i][j] >= 0.6)
    kept = {r.doc_id for r in p.drop_near_duplicates(spark, docs, SF).collect()}
    assert {rows[i].doc_id for i in set(most)} <= kept <= {rows[i].doc_id for i in set(sure)}
    assert len(kept) < len(rows)


def test_stages_of_odd_rows(spark, odd, none, labels, tmp_path):
    """Null ids, texts and sources, repeats, long texts and clashing names, at every stage."""
    import corpus_pipeline as p

    sf = str(tmp_path)
    labels.write.parquet(sf + "/labels.parquet")
    before = rows_of(odd)
    at = {c: k for k, c in enumerate(odd.columns)}
    for name, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0, name
        got = stage(spark, odd, sf)
        if name == "piece encoding":
            found = got.collect()
            assert len(found) == odd.count() and got.columns[:2] == ["doc_id", "source"]
            texts = Counter(r["text"] for r in odd.select("text").collect())
            assert sum(r["n_pieces"] == 0 for r in found) == texts[None] + texts[""] and all(len(r["ids"]) == r["n_pieces"] for r in found)
            continue
        after = rows_of(got)
        assert got.columns == odd.columns and set(after) <= set(before), name
        if name == "toxicity":  # copies share their verdict, and no row comes twice
            assert all(after[r] == before[r] for r in after)
            assert len({r in after for r in before if not r[at["text"]]}) == 1
        elif name == "quality rules":  # all but one text are too short, and that one repeats itself
            assert not after
        elif name == "near-dedup":
            assert all(n == 1 for n in after.values())
            ids = sorted((-1 if r[0] is None else r[0], r[at["text"]] or "") for r in after)
            assert [i for i, _ in ids] == [-1, 1, 3, 6, 7, 7, 8, 9] and dict(ids)[-1] == "no id here"
        else:
            assert set(after) == set(before)
            tokens = lambda rows, source: sum(max(1, len(words_of(r[at["text"]]))) * n for r, n in rows.items() if r[at["source"]] == source)
            for source in ("a", "b", "c", None):
                longest = max(max(1, len(words_of(r[at["text"]]))) for r in before if r[at["source"]] == source)
                assert tokens(after, source) <= p.MOST_REPEATS * tokens(before, source) + longest, source


def test_run_of_odd_rows(spark, odd, labels, tmp_path):
    import corpus_pipeline as p

    text = " ".join(f"word{i}" for i in range(60)) + "."
    more = [(20, text, "en", "a"), (21, text, "en", "b"), (None, text + " tail", "en", None), (22, text.replace("word", "other"), None, "b")]
    docs = odd.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string, source string"))
    docs.selectExpr("*", "length(text) AS n_chars", "'x' AS ids", "'y' AS _row", "1 AS kept").write.parquet(str(tmp_path / "documents.parquet"))
    labels.limit(0).write.parquet(str(tmp_path / "labels.parquet"))  # half of the few labels are toxic, and so would be every text
    got = p.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.collect()} == {20, 22} and all(r.n_pieces > 0 for r in got.collect())
