import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotagraph.llm import chat, mixing, ngram, pieces, queries, simhash, tokenbin, urls


def path(name):
    return queries.tokenizer_path(name)


# ---- URL filters


def test_urls_equal_brute_force(spark):
    hosts = ["a.net", "net", "xnet", "example.net", "w.example.net", "b.example.com", "fr.org", "a.org", ""]
    paths = ["", "/", "/en/", "/en", "/english", "/de/x/y", "/fr/a/", "/en/x/index.html"]
    rows = [(i, f"http://{h.upper()}{p}{q}") for i, (h, p, q) in enumerate((h, p, q) for h in hosts for p in paths for q in ("", "?a=/b", "#x"))]
    rows += [(None, None), (7, None), (7, "no scheme.net/"), (8, "x://"), (8, "x://"), (9, "http://a.net/" + "d/" * 300), (10, "http://" + "a." * 40 + "example.net/en/" + "/" * 40_000), (11, "http://x.\u00c9.net/de/"), (12, "http://x.\u00e9.net/de/"), (13, "http://net" + "." * 5000 + "net/")]
    rule_rows = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"), ("example.net", "/en", "block"), ("example.net", "/en/x/in", "block"), (None, "/", "block"), ("\u00c9.NET", "/de/", "allow")]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS host", "2 AS digest"), spark.createDataFrame(rule_rows, "host string, path string, verdict string")).collect()

    def judge(url):
        m = re.match(r"[\s\S]*?://([^/?#]*)([^?#]*)", url or "")
        lower = lambda x: re.sub("[A-Z]", lambda c: c[0].lower(), x)
        host, p = (lower(m[1]), m[2]) if m else ("", "")
        fits = [(len(h + q), len(h), v, h + q) for h, q, v in ((h and lower(h), q, v) for h, q, v in rule_rows) if h and (host == h or host.endswith("." + h)) and p.startswith(q)]
        best = max(fits, default=None)
        return host, p, best and best[3], best[2] if best else "allow"

    assert Counter((r.page_id, *r[1:]) for r in got) == Counter((i, *judge(u)) for i, u in rows)


# ---- token files


def test_token_files_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = sorted(tokenbin.encode_to_shards(odd, path("byte_bpe_50k.json"), 2).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r.doc_id for r in odd.collect()), key=lambda i: (i is not None, i))
    want = Counter()
    for r in odd.select("doc_id", "text").collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in rows) == want
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1].tolist()]
    assert tokenbin.encode_to_shards(none, path("byte_bpe_50k.json"), 2).count() == 0


def test_query_encodes_like_a_plain_call(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path("byte_bpe_50k.json"))
    texts = ["a b", "<|endoftext|>", "one two<|endoftext|>three four", " <|endoftext|> <|endoftext|>", "<|endoftext| > b", "two three four"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sorted(queries.op4_token_files(spark, str(tmp_path)).collect(), key=lambda r: r.doc_id)
    want = [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]
    assert 50256 in want[1]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in want]
    assert [r.start for r in rows] == [0, *np.cumsum([len(x) for x in want])[:-1].tolist()]


def test_segments_encode_like_whole_texts():
    e = tokenbin.SegmentEncoder(path("byte_bpe_50k.json"))
    texts = ["", " ", "a", " a", "a  b", "a \n b", "it's we'll, x", "x\n y", "\u00e9t\u00e9 \u00e0 la", "tab\t tab \t", "12 ab3 , . !", "<|endoftext|> x<|endoftext|>", "\u2003 a \u2003b", "end "]
    for batch in (texts, texts[::-1], texts):
        for t, ids in zip(batch, e.encode(batch), strict=True):
            assert ids.tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_shards_give_random_access(tmp_path):
    w = tokenbin.ShardWriter(str(tmp_path / "s.arrow"), np.uint16, sequence=8, batch=3)
    flat = np.arange(100, dtype=np.uint16)
    for lo in range(0, 100, 7):
        w.add(flat[lo : lo + 7])
    w.close()
    import pyarrow as pa

    r = tokenbin.ShardReader(pa.memory_map(str(tmp_path / "s.arrow")), batch=3)
    assert r.ids(5, 50).tolist() == list(range(5, 55)) and r.ids(0, 0).tolist() == []
    ids, mask = r.sequence_at(12)
    assert ids.tolist() == [96, 97, 98, 99, 0, 0, 0, 0] and mask.tolist() == [True] * 4 + [False] * 4


# ---- pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(path("piece_bpe_32k.model"))


def test_viterbi_finds_the_best_path(model):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(path("piece_bpe_32k.model"), "rb").read())
    kinds = pb.ModelProto.SentencePiece
    normal = {p.piece: p.score for p in proto.pieces if p.type == kinds.NORMAL}
    most, low = max(normal.values()), min(normal.values()) - 10
    scores = normal | {p.piece: len(p.piece) * most - 0.1 for p in proto.pieces if p.type == kinds.USER_DEFINED}
    for t in ["", "a", " ", "  ", "Hello  world ", "   a\n\n b", "\u65e5\u672c\u8a9e", "\U0001f600 x\x00y", "\u00e9\u00e9  \u00e9", " lead", "trail  ", "the thinking hand", "0x00 <0x41>"]:
        x = model.prepared(t)
        best = [0.0] + [-math.inf] * len(x)
        for j in range(1, len(x) + 1):
            for i in range(max(0, j - 16), j):
                own = scores.get(x[i:j], low if j - i == 1 else None)
                if own is not None:
                    best[j] = max(best[j], best[i] + own)
        ids = model.encode(t).tolist()
        # byte pieces spell one unknown character each
        raw = bytes(model.byte_of[i] for i in ids if i in model.byte_of).decode()
        got = sum(scores[model.pieces[i]] for i in ids if i not in model.byte_of) + low * len(raw)
        assert got == pytest.approx(best[-1]), t
        assert model.decode(ids) == t


def test_words_run_like_whole_texts(model):
    for t in ["one two  three", "a b " * 50, "x" * 200 + " y", "  ", "a\u2581b"]:
        assert model.encode(t).tolist() == model.viterbi(model.prepared(t))


def test_paths_are_those_of_the_librarys_lattice(model):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(path("piece_bpe_32k.model"), "rb").read())
    proto.trainer_spec.model_type = 1  # the same pieces and scores, as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for t in "the thinking hand, unbelievable Stra\u00dfenbahn! internationalisation 12.5 caf\u00e9s".split():
        assert [model.pieces[i] for i in model.encode(t)] == library.nbest_encode_as_pieces(t, 2)[0], t


def test_piece_operator(spark, odd, none):
    name = path("piece_bpe_32k.model")
    encoded = pieces.encode_pieces(odd.withColumn("decoded", F.lit(1)), name, keep_text=True)
    rows = pieces.decode_pieces(encoded, name, into="decoded").collect()
    assert len(rows) == odd.count() and all(r.decoded == (r.text or "") and r.n_pieces == len(r["ids"]) for r in rows)
    assert {r.n_pieces for r in rows if r.doc_id in (3, 4)} == {0}
    assert "text" not in pieces.encode_pieces(odd, name).columns and pieces.encode_pieces(none, name).count() == 0
    ids = spark.createDataFrame([([],), (None,), ([5, None],), ([32000],), ([-1],), ([1, 2],), ([3 + 0xC3, 3 + 0xA9, 3 + 0xFF],)], "ids array<int>")
    assert [r.text for r in pieces.decode_pieces(ids, name).collect()] == ["", None, None, None, None, "", "\u00e9\ufffd"]


# ---- chat


def test_templates():
    run = lambda source, **v: "".join(t for t, _ in chat.compile_template(source)(v.pop("messages", []), **v))
    assert run("{{ 1 + 2 }}{% if 'a' == 'b' %}x{% elif x %}y{% else %}z{% endif %}", x=1) == "3y"
    assert run("{% for m in messages %}{{ loop.index }}{{ m.role }}{% if not loop.last %}, {% endif %}{% endfor %}", messages=[{"role": "a"}, {"role": "b"}]) == "1a, 2b"
    assert run("{% set x = 'q' ~ 1 %}{{ x | upper }} {{- none_such | default('d') }}") == "Q1d"
    assert chat.fold(chat.parse("a{{ 'b' + 'c' }}{% if false %}x{% endif %}{{ 2 }}")) == [("text", "abc2")]
    for bad in ("{{ x.__class__() }}", "{{ open('x') }}", "{% for x %}{% endfor %}", "{% if x %}", "{{ x | nothing }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    assert run("{{ x.__class__ }}", x="text") == ""


def test_conversations(spark):
    hard = "\\<turn user></turn>\n\\"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 1, "assistant", hard), (2, 0, None, None), (None, 3, "assistant", "x>"), (None, None, "user", ""), (3, 0, "assistant", "y" * 5000), (3, 1, "a>b", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS part", "'x' AS mask")
    import hashlib

    for part in (1 << 20, 50):
        got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df, part=part)).collect()}
        assert set(got) == {1, 2, 3, None}
        for conv, r in got.items():
            own = sorted(((t is not None, t or 0, a or "", b or "") for c, t, a, b in rows if c == conv))
            said = "".join(f"{a}\n{b}\n" for _, _, a, b in own)
            loss = "".join(b for _, _, a, b in own if a == "assistant")
            assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(said.encode()).hexdigest())
            assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# ---- near-dedup


def test_covering():
    from itertools import combinations

    assert all(any(set(t) <= set(q) for t in simhash.FAMILY) for q in combinations(range(8), 4))


@pytest.mark.parametrize("longest", [16384, 6])
def test_links_connect_what_brute_force_does(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST", longest)
    r = np.random.default_rng(5)
    base = r.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:20].tolist():
        for _ in range(12):
            x = b
            for bit in r.choice(64, r.integers(1, 7), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    rows = [(int(x),) for x in fps.view(np.int64)]
    got = {(r.node & (1 << 64) - 1): r.root for r in simhash.connected(simhash.links(spark.createDataFrame(rows, "fp long"))).collect()}
    part = {int(x): int(x) for x in fps}
    near = {int(x): fps[np.bitwise_count(fps ^ x) <= 4].tolist() for x in fps}
    for x in part:
        todo, seen = [x], {x}
        while todo:
            for y in near[todo.pop()]:
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        part[x] = frozenset(seen)
    for x in part:
        for y in part:
            assert (y in part[x]) == (x == y or x in got and y in got and got[x] == got[y])


def test_fingerprints_equal_brute_force(odd, spark):
    import xxhash

    texts = ["a", "a b", "A b c D", "a b c d", "a b c d e f g a b c d e", "\u00c4 \u00e4 x\u00a0y z " * 9, "w " * 500]
    df = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in simhash.fingerprints(df).join(df.withColumnRenamed("doc_id", "id"), "id").where("text_hash = coalesce(xxhash64(text), 0) OR text IS NULL").collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert r.fp & (1 << 64) - 1 == want, (r.text or "")[:50]


@pytest.mark.parametrize("longest", [16384, 6])
def test_similar_texts_are_found(spark, monkeypatch, longest):
    monkeypatch.setattr(simhash, "LONGEST", longest)
    r = np.random.default_rng(8)
    word = lambda: "w" + str(r.integers(0, 5000))
    texts, near = [], 0
    for i in range(60):
        words = [word() for _ in range(int(r.integers(60, 300)))]
        texts.append(words)
        for _ in range(3):
            other = list(words)
            for _ in range(max(1, len(words) // 60)):
                other[int(r.integers(0, len(words)))] = word()
            texts.append(other)
    sets = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    rows = simhash.near_duplicates(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"), similar=True).collect()
    of = {x.doc_id: x.component_id for x in rows}
    alike = found = wrong = 0
    for i, a in enumerate(sets):
        for j in range(i):
            s = len(a & sets[j]) / len(a | sets[j])
            alike += s >= 0.8
            found += s >= 0.8 and of[i] == of[j]
            wrong += s < 0.2 and of[i] == of[j]
    assert alike > 100 and found >= 0.95 * alike and not wrong


def test_near_duplicates_of_odd_rows(odd, none):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows}
    assert by[3].fingerprint == "0" * 16 == by[4].fingerprint and by[4].component_id == 3 and by[2].component_id == 1
    kept = simhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, None, 6, 7, 7, 8, 9])
    assert simhash.deduplicated(odd, similar=False).count() == 8
    assert simhash.near_duplicates(none).count() == 0 and simhash.deduplicated(none).count() == 0


# ---- LM scores


@pytest.mark.parametrize("chunk", [1 << 22, 300, 50])
def test_scores_equal_brute_force(spark, odd, monkeypatch, chunk):
    monkeypatch.setattr(ngram, "CHUNK", chunk)
    if chunk == 50:  # many groups of chunks, merged first
        monkeypatch.setattr(ngram, "FAN", 7)
        monkeypatch.setattr(ngram, "SUPER", 4)
        monkeypatch.setattr(ngram, "BUCKET", 100)
    seen = {}
    learn = ngram._learned
    monkeypatch.setattr(ngram, "_learned", lambda *a: seen.setdefault("w", learn(*a)))
    more = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * k) % 11}" for k in range(i % 13))) for i in range(100, 160)], "doc_id long, text string")
    docs = odd.select("doc_id", "text").unionByName(more)
    if chunk == 50:
        docs = docs.where("coalesce(length(text), 0) < 1000")
    learns = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    rows = ngram.score(docs.selectExpr("*", "1 AS id", "'x' AS mode"), learns).collect()
    got = docs.select("doc_id", "text", learns.alias("learns"), (F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(8)) == 0).alias("held")).collect()
    toks = [[*(r.text or "").encode().lower().split(), b"\n"] for r in got]
    count = {held: (Counter(), Counter()) for held in (False, True)}
    for r, t in zip(got, toks, strict=True):
        if r.learns:
            count[r.held][0].update(t)
            count[r.held][1].update(zip([b"\n", *t[:-1]], t, strict=True))
    one, two = (count[False][k] + count[True][k] for k in (0, 1))
    n, kinds, w = sum(one.values()), len(one), seen["w"]
    learned = plain_weights(*count[False], count[True][1])
    for k, (a, b) in learned.items():
        assert w.a[k] == pytest.approx(a, abs=0.01) and w.b[k] == pytest.approx(b, abs=0.01), k
    want = []
    for r, t in zip(got, toks, strict=True):
        plain = sum(math.log10((one[x] + 1) / (n + kinds + 1)) for x in t)
        mixed = 0.0
        for h, x in zip([b"\n", *t[:-1]], t, strict=True):
            k = min(one[h].bit_length(), ngram.FREQUENCIES - 1)
            mixed += math.log10(w.a[k] * two[h, x] / max(1, one[h]) + w.b[k] * one[x] / n + (1 - w.a[k] - w.b[k]) / (kinds + 1))
        want.append((r.doc_id, len(t), sum(one[x] > 0 for x in t), n, plain, mixed))
    key = lambda r: (str(r[0]), *r[1:4], round(r[4], 3))
    assert len(rows) == len(want)
    for r, x in zip(sorted(map(tuple, rows), key=key), sorted(want, key=key), strict=True):
        assert r[:4] == x[:4] and r[4:] == pytest.approx(x[4:], rel=1e-9)


def plain_weights(one, two, held):
    """Expectation-maximisation, a token at a time, over held-out bigrams; buckets with a context."""
    n, kinds, out = sum(one.values()), len(one), {}
    for k in {one[h].bit_length() for h, _ in held if one[h]}:
        tokens = [(two[h, x] / one[h], one[x] / n, 1 / (kinds + 1), c) for (h, x), c in held.items() if one[h].bit_length() == k]
        w = [1 / 3] * 3
        for _ in range(2000):
            shares = [0.1] * 3
            for *p, c in tokens:
                total = sum(a * b for a, b in zip(w, p, strict=True))
                for j in range(3):
                    shares[j] += c * w[j] * p[j] / total
            w = [s / sum(shares) for s in shares]
        out[min(k, ngram.FREQUENCIES - 1)] = w[0], w[1]
    return out


def test_scores_of_nothing(none, odd):
    assert ngram.score(none, F.lit(True)).count() == 0
    assert all(r.train_tokens == 0 and math.isfinite(r.score) for r in ngram.score(odd, F.lit(False)).collect())


# ---- mixing


def solved(spark, tokens, **how):
    m = mixing.solve(spark.createDataFrame(list(tokens.items()), "source string, n long"), **how)
    rows = {r.source: r for r in m.sources.collect()}
    return m, {s: r.weight for s, r in rows.items()}, {s: r.quota for s, r in rows.items()}


def plain_weights_of(tokens, alpha):
    powers = {s: n**alpha if n else 0.0 for s, n in tokens.items()}
    return {s: p / sum(powers.values()) for s, p in powers.items()}


def test_exponent_meets_its_targets(spark):
    tokens = {"a": 6000, "b": 1000, "c": 500, None: 0}
    entropy = lambda w: -sum(x * math.log2(x) for x in w.values() if x)
    m, w, _ = solved(spark, tokens, target_entropy=1.4, budget=1000)
    assert abs(entropy(w) - 1.4) < 1e-9 and w[None] == 0 and w == pytest.approx(plain_weights_of(tokens, m.alpha))
    m, w, q = solved(spark, tokens, most_repeats=2)
    assert q["a"] == 6000 and max(q[s] / n for s, n in tokens.items() if n) == pytest.approx(2, rel=1e-3)
    assert m.alpha == pytest.approx(1 - math.log(2) / math.log(12))
    for budget, limit in ((9000, 1.5), (30000, 4.5)):
        m, w, q = solved(spark, tokens, budget=budget, most_repeats=limit)
        repeats = lambda a: max(budget * x / tokens[s] for s, x in plain_weights_of(tokens, a).items() if tokens[s])
        assert repeats(m.alpha) <= limit * (1 + 1e-9) and repeats(m.alpha - 1e-6) > limit and sum(q.values()) in range(budget - 3, budget + 1)
    assert solved(spark, tokens, most_repeats=100)[0].alpha == 0 and solved(spark, tokens, budget=10**6, most_repeats=2)[0].alpha == 1
    assert solved(spark, {"a": 0}, most_repeats=2)[2] == {"a": 0}


def test_places_equal_a_plain_walk(spark, odd, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 12)
    docs = odd.select("doc_id", "text", "source").where("length(text) < 1000 OR text IS NULL")
    more = spark.createDataFrame([(100 + i, "w " * (i % 9), "abc"[i * i % 3]) for i in range(50)], "doc_id long, text string, source string")
    docs = docs.unionByName(more)
    m, given = mixing.mix(docs, budget=400, most_repeats=3, seed=4)
    got = Counter((r.id, r.text_hash, r.source, r.epoch, round(r.position, 9)) for r in given.collect())
    hashed = docs.selectExpr("doc_id AS id", "CASE WHEN text IS NULL THEN 0 ELSE xxhash64(text) END AS h", "source", "text").collect()
    from itertools import product

    rows = {(i,) for i in range(40)} | {(e, b) for e, b in product(range(9), range(40))} | {(x.id, x.h) for x in hashed} | {(e, x.id, x.h) for e in range(9) for x in hashed}
    order = {}
    for n in (2, 3):
        own = [k for k in rows if len(k) == n]
        names = [f"k{j}" for j in range(n)]
        hashes = spark.createDataFrame(own, ", ".join(f"{c} long" for c in names)).selectExpr(*names, f"shiftrightunsigned(xxhash64(4, {', '.join(names)}), 2) AS h").collect()
        order |= {tuple(r[:n]): r.h for r in hashes}

    want = Counter()
    for r in m.sources.collect():
        own = [(x.id, x.h, max(1, len(re.findall(r"[^\x20\x09-\x0D]+", x.text or "")))) for x in hashed if x.source == r.source]
        blocks = max(1, r.tokens // 12)
        of = [order[i, h] % blocks for i, h, _ in own]
        at, epoch = 0, 0
        while at < r.quota:
            for block in sorted(set(of), key=lambda b: (order[epoch, b], b)):
                members = [x for x, b in zip(own, of, strict=True) if b == block]
                for i, h, n in sorted(members, key=lambda x: (order[epoch, x[0], x[1]], x[0] is not None, x[0] or 0, x[1])):
                    if at < r.quota:
                        want[i, h, r.source, epoch, round((at + 0.5) / r.quota, 9)] += 1
                    at += n
            epoch += 1
    assert got == want and max(r.quota for r in m.sources.collect()) > 100


def test_mixture_of_odd_rows(odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 5)
    m, given = mixing.mix(odd, most_repeats=3)
    rows = given.collect()
    times = Counter((r.id, r.text_hash) for r in rows)
    assert len(times) == odd.select("doc_id", "text").distinct().count()  # every document at least once
    assert max(r.epoch for r in rows) <= 2 and all(0 < r.position <= 1 for r in rows)
    for s, quota in ((r.source, r.quota) for r in m.sources.collect()):
        own = sorted((r.position, r.n_tokens) for r in rows if r.source == s)
        assert sum(n for _, n in own) >= quota > sum(n for _, n in own[:-1])
    again = mixing.mixed_documents(odd, most_repeats=3)
    assert again.columns == odd.columns and again.count() == len(rows)
    assert mixing.mix(none, most_repeats=3)[1].count() == 0 and mixing.mixed_documents(none, most_repeats=3).count() == 0
