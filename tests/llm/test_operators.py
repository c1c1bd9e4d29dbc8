"""The ten operators on small tables with nulls, ties, repeats, long texts and odd columns."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F

from graphspan.llm import bloom, bpe, chat, exact_dedup, gray_index, line_dedup, packing, simhash, substring_dedup, tokens, toxicity, url_filter, vector_search

DOC = "doc_id long, text string, lang string, source string, n_chars long, td string, digest string, kept string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", 1, "x", "y", "z") for i, t in rows], DOC)


def prose(n, seed=0):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopéß") for _ in range(r.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = prose(300, 1)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "One two."), (5, "One two."), (5, "One two."), (None, "One two."), (None, None),
        (6, base), (7, base + " tail"), (8, base[:900]), (9, prose(20000, 2)), (10, "ab" * 700), (11, "line\n LINE \nother\n" * 3), (12, "漢字😀 x  y \x1c z"),
    ]


def test_exact_dedup(spark, rows):
    got = exact_dedup.exact_dedup(docs_of(spark, rows)).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    assert len(got) == len(rows)
    for r in got:
        own = next(g for t, g in groups.items() if hashlib.sha256(t.encode()).digest() == bytes(r.digest))
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    assert Counter(bytes(r.digest) for r in got if r.kept) == {hashlib.sha256(t.encode()).digest(): 1 for t in groups}
    kept = exact_dedup.drop_duplicates(docs_of(spark, rows))
    assert kept.columns == docs_of(spark, rows).columns and Counter(r.text or "" for r in kept.collect()) == dict.fromkeys(groups, 1)
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


def test_misra_gries_keeps_the_frequent(spark):
    many = [(i, "hot" if i % 3 == 0 else f"t{i}") for i in range(3000)]
    d = exact_dedup.exact_dedup(docs_of(spark, many), counters=8)
    assert d.filter("kept").count() == 2001 and d.filter("group_size = 1000").count() == 1000


def test_vector_search_against_brute_force(spark):
    r = np.random.default_rng(0)
    v = r.normal(size=(400, 8)).astype("f4")
    v[50:90] = v[0]  # ties
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 8), (None, [1.0] * 8), (1100, [float("inf")] * 8), (1200, []), (1300, [2.0**60] * 8)]
    df = spark.createDataFrame([(i, x, 0) for i, x in data], "vec_id long, embedding array<float>, score int")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in vector_search.op2(df).collect()}
    ok = {i: [int(np.floor(1024.0 * float(c))) for c in x] for i, x in data if i is not None and x is not None and all(c is not None and np.isfinite(c) for c in x)}
    want = {}
    for q in (i for i in ok if i % 100 == 0):
        s = sorted((-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(ok[q], ok[c], strict=False)))), c) for c in ok if c != q)[:10]
        want |= {(q, k): (c, -x) for k, (x, c) in enumerate(s, 1)}
    assert got == want
    assert vector_search.op2(df.limit(0)).count() == 0


def test_vector_search_over_files_in_any_order(spark):
    """A task reads files by size: the long vectors here compress well and come last."""
    r = np.random.default_rng(5)
    v = (r.normal(size=(10_000, 16)) * r.uniform(0.1, 1, (10_000, 1))).astype("f4")
    v[6000:] = r.choice([-1, 1], (4000, 16)) * r.choice([50, 100, 400], (4000, 1))
    v = v[r.permutation(len(v))]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    conf = {"spark.sql.shuffle.partitions": "12", "spark.sql.files.minPartitionNum": "1"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in vector_search.op2(df).collect()}
    finally:
        for k, x in old.items():
            spark.conf.set(k, x) if x is not None else spark.conf.unset(k)
    c = np.floor(1024.0 * v.astype(float)).astype(np.int64)
    want = {}
    for q in range(0, len(c), 100):
        score = c @ c[q]
        best = [i for i in np.lexsort((np.arange(len(c)), -score))[:11].tolist() if i != q][:10]
        want |= {(q, k): (i, int(score[i])) for k, i in enumerate(best, 1)}
    assert got == want


def test_bpe_equals_tiktoken_and_comes_back(spark, rows):
    import tiktoken

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.op3(docs_of(spark, rows)).collect()
    want = []
    for i, t in rows:
        ids = own.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    at = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    back = bpe.decode(bpe.encode(docs_of(spark, rows), *at, starts="at"), *at, out="again").filter("get(at, 0) <> 0 OR CAST(again AS STRING) <> coalesce(text, '')")
    assert back.count() == 0
    enc = tokens.encoder(*at)
    table = tokens.token_bytes(enc.tokenizer)
    ids = enc.encode("漢字😀 é").tolist()
    assert "".join(tokens.decode_stream(([i] for i in ids), table)) == "漢字😀 é"


def test_simhash_index_and_components(spark, rows):
    r = np.random.default_rng(3)
    x = r.integers(0, 2**63, 30, dtype=np.uint64).repeat(40)
    for k in range(6):
        x ^= np.where(r.random(len(x)) < 0.5, np.uint64(1) << r.integers(0, 64, len(x)).astype(np.uint64), np.uint64(0))
    x = np.unique(x)
    x = x[np.argsort(gray_index.gray_rank(x))]
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= 4
    q, c = gray_index.GrayIndex(x).search(x, 4)
    assert len(q) == near.sum() and near[q, c].all()
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_dedup(docs_of(spark, rows), hot_key=2).collect()}
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    assert simhash.fingerprint(" \n ") == 0 and simhash.fingerprint("One  TWO") == xxhash.xxh64_intdigest("one two", 42)
    root = {f: {f} for _, f in fps}
    for a in root:
        for b in root:
            if bin(a ^ b).count("1") <= 4 and root[a] is not root[b]:
                both = root[a] | root[b]
                for f in both:
                    root[f] = both
    least = lambda f: min((i for i, g in fps if g in root[f] and i is not None), default=None)
    assert got == {(i, f - (1 << 64) if f >> 63 else f, least(f)) for i, f in fps}
    assert simhash.near_dedup(docs_of(spark, [])).count() == 0


def test_toxicity(spark, rows):
    texts = [(i, prose(30, i) + (" idiot scum" if i % 4 == 0 else "") + (" women" if i % 8 == 0 else "")) for i in range(400)]
    df = docs_of(spark, texts + [(10_000 + k, t) for k, (_, t) in enumerate(rows)])
    labels = spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i, _ in texts] + [(None, 0, 1), (3, 0, None), (5, 0, 7)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.op5(df, labels).collect()}
    assert len(got) == df.count() and all(0 <= r.score <= 1 for r in got.values())
    held = [r for i, r in got.items() if i < 400 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in held]) > 0.95
    plain = toxicity.train(df, labels)
    of = plain.scorer()
    assert abs(of("some women here") - of("some men here")) < 0.05  # a mention alone changes little
    assert toxicity.op5(df, labels.limit(0)).filter("predicted = 1").count() == 0


def test_line_dedup(spark, rows):
    data = rows + [(100 + i, f"own {i}\n  Shared Line\t\n\nx") for i in range(12)]

    def brute(least_docs):
        n = Counter(k for _, t in data for k in set(line_dedup.keys_of(t or "")) if k)
        bad = {k for k, c in n.items() if c >= least_docs}
        out = []
        for i, t in data:
            lines = (t or "").split("\n")
            kept = [x for x, k in zip(lines, line_dedup.keys_of(t or ""), strict=True) if k not in bad]
            out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
        return sorted(out, key=str)

    for held in (1000, 0, 5):  # broadcast, by a shuffle, and some of both
        assert sorted(map(tuple, line_dedup.drop_lines(docs_of(spark, data), held_rows=held).collect()), key=str) == brute(10)
    first = line_dedup.drop_lines(docs_of(spark, data), keep="first").filter("kept LIKE '%Shared%'").collect()
    assert [r.doc_id for r in first] == [100]
    assert line_dedup.drop_lines(docs_of(spark, [])).count() == 0


def test_bloom_misses_nothing():
    r = np.random.default_rng(1)
    filters = bloom.OnceTwice(1 << 16)
    a, b = (r.integers(0, 2**63, 500, dtype=np.uint64) for _ in "ab")
    filters.add(a)
    filters.add(np.concatenate([a[:50], b]))
    assert bloom.has(filters.once, b).all() and bloom.has(filters.twice, a[:50]).all() and not bloom.has(filters.twice, b).all()


def test_url_filter(spark):
    import duckdb

    urls = [None, "no scheme", "http://A.Example.com:80/en/7?x", "https://example.com/en/71#a", "http://x.com/en/8", "http://com/en/", "ftp://example.net/de/88/a/b/c/d", "http://q.net/de/1", "http://org", "http://sub.org/es/x", "a://b://c/d"]
    urls += [f"http://example.com/en/p{i}" for i in range(60)] + [f"http://s.org/es/{i}.html" for i in range(5)] * 2
    df = spark.createDataFrame([(i if i else None, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, html string, rule string")
    got = url_filter.op7(df).collect()
    pages = df.select("page_id", "url").toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages)
    want = con.execute(url_filter.oracle_sql()).df()[["page_id", "host", "path", "rule", "verdict"]]
    clean = lambda rows: sorted(str((None if r[0] is None or r[0] != r[0] else int(r[0]), r[1], r[2], r[3] if isinstance(r[3], str) else None, r[4])) for r in rows)
    assert clean(map(tuple, got)) == clean(want.itertuples(index=False))
    by = {r.page_id: r for r in got}
    assert by[2].host == "a.example.com:80" and by[3].rule == "example.com/en/7" and by[3].verdict == "allow" and by[6].verdict == "block" and by[8].path == ""
    labels = spark.createDataFrame([(i, True) for i in range(12, 50)], "page_id long, bad boolean")
    learned = {r.page_id: r.verdict for r in url_filter.judge(df, labels, rules=()).collect()}
    assert learned[65] == "block" and learned[7] == "allow"
    assert url_filter.op7(df.limit(0)).count() == 0


@pytest.mark.parametrize("broadcast", [True, False])
def test_url_tree(spark, broadcast, monkeypatch):
    """Deep branches are told apart, variable segments become wildcards at any depth, siblings
    alike are merged and others are not; the SQL agrees where rules label the pages."""
    import duckdb

    if not broadcast:
        monkeypatch.setattr(url_filter, "BROADCAST_BYTES", -1)
    urls = [f"http://h.com/a/b/c/good/x{i}" for i in range(30)] + [f"http://h.com/a/b/c/bad/y{i}" for i in range(30)]
    urls += [f"http://h.com/u{i}/profile" for i in range(20)] + [f"http://h.com/u{i}/photos/{k}" for i in range(20) for k in "abc"]
    urls += [f"http://g.com/en/{i}" for i in range(40)] + [f"http://g.com/fr/{i}.html" for i in range(20)] + [f"http://g.com/static/{k}/v{i}" for k in "pq" for i in range(20)] + ["http://g.com/<*>/", "http://g.com//en//", "http://g.com/" + "/".join("z" * 300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    labels = spark.createDataFrame([(i, i >= 30) for i in range(60)] + [(140 + i, True) for i in range(40)], "page_id long, bad boolean")
    got = {urls[r.page_id]: (r.template, r.verdict) for r in url_filter.judge(df, labels, rules=()).collect()}
    assert got["http://h.com/a/b/c/good/x3"] == ("/a/b/c/good/<*>", "allow") and got["http://h.com/a/b/c/bad/y3"] == ("/a/b/c/bad/<*>", "block")
    assert got["http://h.com/u3/profile"][0] == "/<*>/profile" and got["http://h.com/u4/photos/b"][0] == "/<*>/photos/<~a>"
    assert got["http://g.com/en/7"] == got["http://g.com/fr/7.html"] == ("/<~en>/<*>", "block")
    assert got["http://g.com/static/p/v1"] == ("/static/<~p>/<*>", "allow") and got["http://g.com/<*>/"][1] == "allow"
    assert len(got) == len(set(urls))
    rules = (("block", "g.com", "/en/"), ("block", "com", "/a/b/c/b"), ("allow", "h.com", "/a/"))
    pages = df.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("pages", pages[pages.url != urls[-1]])
    want = {r[0]: r[4] for r in con.execute(url_filter.oracle_sql(rules)).df()[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False)}
    assert {r.page_id: r.verdict for r in url_filter.judge(df.filter(F.col("page_id") < len(urls) - 1), rules=rules).collect()} == want and want[190] == "block"


def test_packing(spark, rows):
    got = packing.op8(docs_of(spark, rows), with_ids=True).collect()
    enc = tokens.tokenizer_of_file(P.path("byte_bpe_50k.json"))
    want = Counter((i, *enc.encode(t or "", add_special_tokens=False).ids, 0) for i, t in rows)
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append(r)
        assert r.length > 0 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
    pad = total = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        total, pad = total + at, pad + (0 if at & (at - 1) == 0 else 1024 - at)
    assert pad <= 0.02 * total and total == sum((len(k) - 1) * n for k, n in want.items())
    single = [i for i, n in Counter(i for i, _ in rows).items() if n == 1]
    for i in single:
        ids = [x for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start) for x in r.ids]
        assert want[(i, *ids)] == 1
    assert packing.op8(docs_of(spark, [])).count() == 0


def removed(texts, depth):
    n = Counter(t[k : k + depth] for t in texts for k in range(len(t) - depth + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - depth + 1):
            if n[t[k : k + depth]] > 1:
                gone[k : k + depth] = b"\1" * depth
        out.append((len(t), sum(gone), len([1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1])]), bytes(c for c, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("hot", [10_000, 3])
def test_suffix_dedup(spark, rows, hot, monkeypatch):
    if hot == 3:  # and ids by a Bloom filter
        monkeypatch.setattr(substring_dedup, "BROADCAST_ROWS", -1)
    shared = prose(90, 7)[:420]
    data = rows[:-4] + [(20 + k, prose(40, 30 + k) + shared + prose(40, 60 + k)) for k in range(6)] + [(30, "é" * 450), (31, prose(30, 90) + "é" * 230), (40, "x" * 399), (41, "x" * 399), (42, "y" * 400)]
    got = substring_dedup.remove_repeated(docs_of(spark, data), hot_digit=hot).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    want = [(i, *x) for (i, _), x in zip(data, removed([(t or "").encode() for _, t in data], 400), strict=True)]
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == Counter(want)
    assert substring_dedup.remove_repeated(docs_of(spark, [])).count() == 0


def test_anchors_of_texts_longer_than_their_position_bits(monkeypatch):
    a, shared, b = (prose(n, k).encode() for n, k in ((9000, 11), (200, 12), (3000, 13)))
    texts = [(k, np.frombuffer(t, np.uint8)) for k, t in ((b"a", a + shared), (b"b", b + shared + b[:50]), (b"c", b""))]
    whole = substring_dedup.first_digits(texts)
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 3000)
    monkeypatch.setattr(substring_dedup, "_POSITION", np.uint64((1 << 12) - 1))
    digits, ids, places, own = substring_dedup.first_digits(texts)
    of = dict(texts)

    def windows(ids, places):
        return Counter((i, s + k) for i, p in zip(ids, places.tolist(), strict=True) for s, _, part in substring_dedup.contexts(of[i], [p]) for k in range(len(part) - 399))

    assert windows(ids, places) == windows(whole[1], whole[2]) == Counter((i, k) for i, t in texts for k in range(len(t) - 399))
    assert own == whole[3] == []
    n = Counter(digits.tolist())
    again = {(i, k) for d, i, p in zip(digits.tolist(), ids, places.tolist(), strict=True) if n[d] > 1 for (_, k) in windows([i], np.array([p]))}
    assert {(b"a", len(a)), (b"b", len(b)), (b"a", len(a) + len(shared) - 400)} <= again


def test_word_codes_and_spans_of_odd_texts(monkeypatch):
    texts = [b"", b" \t\n", "(one) two, \u00e9 -- 'x'".encode(), b"one two", b",,, one", b"x" * 50]
    codes = substring_dedup.word_codes(texts)
    words = [t.split() for t in texts]
    bare = [[w.strip(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~") or w for w in ws] for ws in words]
    assert [len(c) for c in codes] == [len(w) for w in words]
    of: dict = {}
    for c, w in zip((int(x) for cs in codes for x in cs), (x for ws in bare for x in ws), strict=True):
        assert of.setdefault(w, c) == c
    assert len(set(of.values())) == len(of)
    assert substring_dedup.word_spans(b" a bb  ccc ", [(0, 1), (1, 3)]) == [(0, 2), (3, 11)]
    long = prose(3000, 8).encode()
    whole = substring_dedup.word_codes([long])[0]
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 500)
    assert (substring_dedup.word_codes([long])[0] == whole).all()


def test_chat(spark):
    data = [(1, 1, "assistant", "a###b</turn>\\"), (1, 0, "user", None), (2, 0, None, ""), (2, 1, "assistant", "x"), (2, 1, "assistant", "#"), (3, None, "assistant", "é😀</" + "#" * 9), (None, 0, "sys: \\x", "q")]
    df = spark.createDataFrame([(*r, "z") for r in data], "conv_id long, turn long, role string, text string, ids string")
    got = {r.conv_id: r for r in chat.op10(spark, df).collect()}
    assert set(got) == {1, 2, 3, None, -7}
    for c, r in got.items():
        turns = sorted(((t if t is not None else -1, a or "", x or "") for i, t, a, x in data if i == c)) if c != -7 else [(0, "user", r"\### Assistant: </turn> ok"), (1, "assistant", r"\### Assistant: </turn> ok")]
        loss = "".join(x for _, a, x in turns if a == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256("".join(f"{a}\n{x}\n" for _, a, x in turns).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for t in ("###", "#\\#", "</turn>", "<\\/", "a\\"):
        assert chat.unescape(chat.escape(t)) == t and "##" not in chat.escape(t) and "</" not in chat.escape(t)


def test_pipeline_on_a_small_table(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tempfile

    bad, copy = prose(60, 5) + " idiot idiot idiot", prose(120, 6)
    texts = [(i, prose(50, 100 + i) + (" idiot scum idiot" if i % 4 == 0 else "")) for i in range(200)] + [(900, copy), (901, copy), (902, copy + " x"), (903, bad), (904, None)]
    d = tempfile.mkdtemp()
    docs_of(spark, texts).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 0, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    got = corpus_pipeline.run(spark, d)
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert 904 in ids and 903 not in ids and len(ids & {900, 901, 902}) == 1
    assert not any(i % 4 == 0 for i in ids if i < 200) and sum(i < 200 for i in ids) == 150


def test_confirmed_copies_keep_other_documents(spark):
    """Copies of a similarity of 0.8 or more go, others stay; so do rows without an id."""
    from graphspan.llm import simhash

    base = [f"w{i * 37 % 211}" for i in range(200)]
    loose = base[:100] + ["other"] + base[101:]  # 196 shingles, 5 changed
    far = base[:40] + [f"z{i}" for i in range(160)]
    rows = [(1, " ".join(base)), (2, " ".join(loose)), (3, " ".join(far)), (4, None), (5, ""), (None, " ".join(base)), (2, " ".join(loose))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("keep_id", simhash.F.lit("x"))
    assert set(map(tuple, simhash.confirmed_copies(docs, most=10).collect())) == {(2, 1), (5, 4)}
    assert simhash.confirmed_copies(docs.filter("false")).count() == 0
    sets = [simhash.shingle_hashes(t or "", 5) for _, t in rows[:3]]
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) >= 0.8 > len(sets[0] & sets[2]) / len(sets[0] | sets[2])


def test_copies_led_by_a_looser_relative_are_found(spark):
    """8 is like 9 but neither is like 1, the smallest id of their family; and 9 variants of
    one text are found over several tasks."""
    from graphspan.llm import simhash

    base = [f"w{i}" for i in range(200)]

    def changed(*at):
        return " ".join("x" + str(i) if i in at else w for i, w in enumerate(base))

    far = tuple(range(0, 200, 20))
    rows = [(1, " ".join(base)), (8, changed(*far)), (9, changed(*far, 5, 105))]
    rows += [(20 + k, prose(150, 40) + f" tail {k}") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert set(map(tuple, simhash.confirmed_copies(docs, most=10, size=2).collect())) == {(9, 8)} | {(20 + k, 20) for k in range(1, 9)}
    assert set(map(tuple, simhash.confirmed_copies(docs, per_task=3).collect())) == {(9, 8)} | {(20 + k, 20) for k in range(1, 9)}


def test_near_stage_keeps_what_only_fingerprints_link(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(300)]
    for seed in range(5000):
        at = set(random.Random(seed).sample(range(300), 9))
        other = " ".join("x" if i in at else w for i, w in enumerate(base))
        a, b = (simhash.shingle_hashes(t, 5) for t in (" ".join(base), other))
        bits = simhash.fingerprint(" ".join(base)) ^ simhash.fingerprint(other)
        if len(a & b) < 0.78 * len(a | b) and bits.bit_count() <= 4:
            break
    else:
        pytest.fail("no such pair")
    docs = docs_of(spark, [(1, " ".join(base)), (2, other), (3, other + " more")])
    assert {r.doc_id for r in corpus_pipeline.near_stage(spark, docs, "").collect()} == {1, 2}


@pytest.mark.parametrize("hot", [10_000, 2])
def test_repeated_passages_of_short_words(spark, hot):
    """51 words of some 150 bytes go from both texts, 50 words between the same blanks stay;
    the query with its 400 bytes alone touches neither."""
    r = random.Random(3)
    words = lambda n: " ".join(r.choice("abcdefgh") + r.choice("ijklmn") for _ in range(n))
    long, short, only = words(51), words(50), words(52)
    texts = [(1, f"{words(70)}Q {long} Q{words(9)}"), (2, f"{words(30)}R ({long.replace(' ', '  ')}), R{words(60)}"), (3, f"{words(20)}S {short} S{words(80)}"), (4, f"{words(45)}T {short} T{words(7)}"), (5, only), (6, only.replace(" ", "\n")), (7, "é" * 450), (8, "x" * 460 + " " + "é" * 300)]
    docs = docs_of(spark, texts)
    kept = {i: bytes(k).decode() for i, k in substring_dedup.remove_repeated(docs, hot_digit=hot, words=51).select("doc_id", "kept").collect()}
    of = dict(texts)
    assert kept == {1: of[1].replace(long, ""), 2: of[2].replace(f"({long.replace(' ', '  ')}),", ""), 3: of[3], 4: of[4], 5: "", 6: "", 7: "", 8: " "}
    if hot > 2:
        corpus_pipeline = pytest.importorskip("corpus_pipeline")
        staged = {r.doc_id: r.text for r in corpus_pipeline.substring_stage(spark, docs, "").collect()}
        assert staged == {i: k for i, k in kept.items() if k}
        assert {r.doc_id for r in substring_dedup.remove_repeated(docs).filter("n_removed > 0").collect()} == {7, 8}


ODD = ["td", "spans", "word_spans", "whole", "kept", "n_bytes", "n_removed", "n_spans", "row", "__text", "__toxicity", "__digest", "__d", "__row", "__id", "digest", "in"]


def odd_docs(spark, rows, n_chars=True):
    """Documents with extra columns named like those that operators use inside."""
    made = [(i, t, len(t or ""), [k], *[f"{c}{k}" for c in ODD]) for k, (i, t) in enumerate(rows)]
    schema = "doc_id long, text string, n_chars int, tags array<int>, " + ", ".join(f"`{c}` string" for c in ODD)
    return spark.createDataFrame(made, schema)


def test_stages_with_odd_tables(spark, tmp_path):
    """Clashing columns, repeated and null ids, empty and long texts, U+FFFD, no rows: each
    stage keeps rows and columns as they are but for its own decisions."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    copy, shared = prose(200, 61), prose(52, 62)  # under 400 bytes
    near = copy.split(" ")
    near = " ".join(near[:100] + ["new"] + near[101:])
    rows = [(1, copy), (2, near), (2, prose(80, 63)), (2, prose(80, 64)), (None, prose(70, 65)), (None, None), (5, ""), (6, "\ufffd alone \ufffd é"), (7, f"\ufffd {prose(30, 66)} {shared} é\ufffd"), (8, f"{shared} {prose(30, 67)}"), (9, prose(30_000, 68)), (10, " \n"), (11, prose(90, 69) + " idiot scum"), (6, "\ufffd alone \ufffd é")]
    docs = odd_docs(spark, rows)
    labels = [(i, 0, int(i == 11)) for i in (1, 7, 8, 9, 11)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        tags = {r.tags[0]: r for r in out.collect()}
        for k, r in tags.items():  # what stays has its own columns
            assert r.doc_id == rows[k][0] and all(r[c] == f"{c}{k}" for c in ODD)
            if name != "suffix_array_dedup":
                assert r.text == rows[k][1] and r.n_chars == len(rows[k][1] or "")
        if name == "exact_dedup":  # null and empty are equal, the two rows of id 6 too
            assert {0, 1, 2, 3, 4, 7, 8, 9, 10, 11, 12} - {7} <= set(tags) and len({5, 6} & set(tags)) == 1 and len({7, 13} & set(tags)) == 1
        if name == "simhash_near_dedup":
            assert set(tags) >= {2, 3, 4, 8, 9, 10, 12} and len({0, 1} & set(tags)) == 1 and len({7, 13} & set(tags)) == 1
        if name == "suffix_array_dedup":
            assert tags[8].text == rows[8][1].replace(shared, "") and tags[9].text == rows[9][1].replace(shared + " ", " ") and tags[8].n_chars == len(tags[8].text)
            assert all(tags[k].text == rows[k][1] for k in (2, 3, 4, 5, 6, 7, 10, 12, 13))
        assert stage(spark, docs.filter("false"), str(tmp_path)).count() == 0
    packed = stages["packing"](spark, docs, str(tmp_path))
    assert packed.filter("start = 0").count() == len(rows) and stages["packing"](spark, docs.filter("false"), str(tmp_path)).count() == 0


def test_encode_beside_clashing_columns(spark):
    df = odd_docs(spark, [(1, "a b"), (2, None)])
    at = P.path("byte_bpe_50k.tiktoken"), P.PATTERN
    out = bpe.decode(bpe.encode(df, *at), *at, out="back")
    assert out.schema.names == [*df.schema.names, "ids", "back"]
    assert sorted(bytes(r.back) for r in out.collect()) == [b"", b"a b"]


def test_fingerprints_by_hand(spark, rows):
    """Every bit counted in plain Python, over whole texts, long ones too."""
    def own(text):
        words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
        h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = {(r.doc_id, r.fp % (1 << 64)) for r in simhash.fingerprints(docs_of(spark, rows)).collect()}
    assert got == {(i, own(t)) for i, t in rows}


def test_scores_by_hand(spark, rows):
    """Scores of the trained weights, summed in plain Python."""
    texts = [(i, prose(30, i) + (" idiot scum" if i % 4 == 0 else "")) for i in range(200)]
    df = docs_of(spark, texts + [(10_000 + k, t) for k, (_, t) in enumerate(rows)])
    model = toxicity.train(df, spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in texts], "doc_id long, toxic int"))
    for r in toxicity.score(df, model).collect():
        n = Counter(s for w, k in toxicity.words(r.text).items() for s in toxicity.stems_of(w) for _ in range(k))
        z = model.bias + sum(model.weights.get(4 * s + level, 0) for s, k in n.items() for level in range(min(3, k)))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_formatted_text_of_turns(spark):
    """formatted_chars counts the text that the ids stand for, markers and escapes included."""
    data = [(1, 0, "user", "a##b"), (1, 1, "assistant", "\\ </turn>"), (2, 0, "sys:x", "é😀")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string")
    shown = {1: "### user: a#\\#b </turn>\n### assistant: \\\\ <\\/turn> </turn>\n", 2: "### sys\\:x: é😀 </turn>\n"}
    got = {r.conv_id: r.formatted_chars for r in chat.op10(spark, df).collect()}
    assert {k: got[k] for k in shown} == {k: len(t) for k, t in shown.items()}


def test_recall_of_near_copies(spark):
    """Of all pairs of a similarity of 0.8 or more, found by brute force over short and long
    texts with a few words changed, at least 0.9 end in one group (here all)."""
    r = random.Random(17)
    texts = []
    for k in range(60):
        base = prose(r.choice([12, 40, 150, 600]), 1000 + k).split(" ")
        texts.append(base)
        for _ in range(3):
            other = list(base)
            for _ in range(r.randint(1, max(1, len(base) // 45))):
                other[r.randrange(len(other))] = "changed" + str(r.random())
            texts.append(other + ["end"] * r.randint(0, 1))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    root = dict(map(tuple, simhash.confirmed_copies(docs).collect()))
    sets = [simhash.shingle_hashes(" ".join(t), 5) for t in texts]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    found = sum(root.get(a, a) == root.get(b, b) for a, b in pairs)
    assert len(pairs) > 50 and found >= 0.9 * len(pairs)
    linked = {frozenset(p) for p in pairs}
    assert all(any(frozenset((a, c)) in linked for c in range(len(sets))) for a in root)


def test_passages_of_a_very_long_text(spark):
    """A repeat behind 16 MiB is found as any other."""
    r = np.random.default_rng(4)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz    ", np.uint8)
    long, passage = letters[r.integers(0, 30, 19_000_000)].tobytes().decode(), prose(120, 71)
    docs = spark.createDataFrame([(1, long + passage + " end"), (2, "start " + passage)], "doc_id long, text string")
    got = {x.doc_id: (x.n_bytes, x.n_removed) for x in substring_dedup.remove_repeated(docs).collect()}
    n = len(passage.encode())
    assert got[1][0] == 19_000_000 + n + 4 and n <= got[1][1] == got[2][1] <= n + 2
