import hashlib
import html
import random
import re
import time
import tracemalloc
from collections import Counter
from hashlib import sha256

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plexweave.llm import bpe, exact_dedup, html_text, langid, licences, mixing, near_dedup, neighbours, substring_dedup, toxicity, words
from plexweave.llm.oracles import ORACLES
from plexweave.llm.queries import QUERIES
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, text_sha256 string"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and repeated texts, ties, repeated rows, and a column whose name clashes."""
    rows = [(None, None, None, None, "x"), (1, "", None, None, None), (1, "a b", None, "s", None), (2, None, "en", "s", "y"), (2, None, "en", "s", "y"), (3, "w " * 30_000, "en", "s", None), (4, "W " * 30_000, "en", "t", None)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def results(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    yield toxicity.scored(docs, toxicity.fit(docs, labels))
    yield exact_dedup.exact_groups(docs)
    yield near_dedup.near_groups(docs)
    yield langid.identified(docs, langid.fit(docs))
    yield mixing.mixed(docs)
    yield substring_dedup.without_repeats(docs)
    yield licences.licence_scan(docs.selectExpr("*", "concat(source, '/x') as path"))
    yield bpe.round_trip(docs)


def test_odd_tables(spark, odd, empty):
    for found in results(spark, odd):
        assert found.count() == 7
    for found in results(spark, empty):
        assert found.count() == 0
    for drop in (exact_dedup.drop_copies, near_dedup.drop_near_copies, mixing.training_order):
        assert drop(odd).columns == odd.columns and drop(empty).count() == 0
    groups = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in near_dedup.near_groups(odd).collect()}
    assert groups[3, 1] == groups[4, 1] == 3 and groups[None, 0] is None
    assert sorted(str(r["doc_id"]) for r in exact_dedup.drop_copies(odd).collect()) == ["1", "2", "3", "4", "None"]


@pytest.mark.parametrize("name", ["op3_neighbours", "op6_mix", "op7_substring_dedup", "op9_exact_dedup", "op2_near_dedup"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    found, expected = QUERIES[name](spark, DATA).toPandas(), con.sql(ORACLES[name]).df()
    columns = sorted(expected.columns)
    order = lambda x: x[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(found), order(expected), check_dtype=False)


@pytest.mark.parametrize("target", [substring_dedup.TARGET, 12])
def test_windows_are_confirmed_by_their_words(spark, monkeypatch, target):
    """Hashes of windows that all collide within a group, large groups or not, take away only what words repeat."""
    monkeypatch.setattr(substring_dedup, "TARGET", target)
    monkeypatch.setattr(substring_dedup, "SAMPLED", 1)
    whole = substring_dedup.rolling
    rng = random.Random(4)
    passage = [f"p{i}" for i in range(20)]
    rows, expected = [], {}
    for k in range(12):
        own = [f"d{k}x{i}" for i in range(8)] + ["same", "three", "words"] + [f"e{k}x{i}" for i in range(rng.randint(8, 12))]
        rows.append((k, " ".join(own + passage * (k % 3 == 0))))
        expected[k] = " ".join(own + passage * (k == 0))
    batch = lambda docs: pa.record_batch([pa.array([k for k, _ in docs]), pa.array([t for _, t in docs]), pa.array([k for k, _ in docs])], ["doc", "text", "doc_id"])
    shared = whole(substring_dedup.line_hashes(b"same three words")[0], 3)
    monkeypatch.setattr(substring_dedup, "rolling", lambda words, n: whole(words, n) * np.uint64(n != 13))
    for groups in (1, 5):
        made = pa.Table.from_batches(list(substring_dedup._suffixes(iter([batch(rows[:5]), batch(rows[5:])]), 13, groups, shared if target == 12 else shared[:0])))
        hits = pa.Table.from_batches(list(substring_dedup._trees(iter(made.sort_by("bucket").to_batches(max_chunksize=3)), 13, groups)))
        texts = pa.Table.from_batches(list(substring_dedup._texts(iter([batch(rows)]), groups)))
        both = pa.concat_tables([texts, hits.append_column("doc_id", pa.nulls(len(hits), pa.int64())).select(texts.column_names)])
        kept = substring_dedup._kept(iter(both.sort_by([("bucket", "ascending"), ("kind", "ascending")]).to_batches(max_chunksize=4)), 13)
        assert {k: b" ".join(substring_dedup.kept_words(w, g)).decode() for k, w, g in kept} == expected
    monkeypatch.setattr(substring_dedup, "rolling", whole)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.without_repeats(docs).collect()
    assert {r["doc_id"]: r["text"] for r in found} == expected
    repeats = {r["doc_id"]: r["repeats"] for r in substring_dedup.maximal_repeats(docs).collect()}
    sizes = {k: len(t.split()) for k, t in rows}
    assert all([tuple(x) for x in repeats[k]] == ([(sizes[k] - 20, 20)] if k % 3 == 0 and k else []) for k in sizes)


def test_repeats_of_rows_with_one_id_or_none(spark):
    """Windows are judged by the words of rows with smaller ids; rows of one id and null ids keep their own places."""
    rng = random.Random(6)
    passages = [" ".join(f"q{k}x{i}" for i in range(16)) for k in range(4)]
    rows = [(rng.choice([1, 2, 3, None]), " ".join([f"u{k}", *rng.sample(passages, rng.randint(0, 3)), f"v{k}"])) for k in range(60)] + [(1, ""), (2, None), (3, passages[0])] * 2
    windows = lambda t: {tuple(t.split()[i : i + 13]) for i in range(len(t.split()) - 12)}
    rank = lambda d: 10 if d is None else d
    expected = []
    for d, t in rows:
        words = (t or "").split()
        earlier = set().union(*(windows(u or "") for e, u in rows if rank(e) < rank(d)))
        gone = {j for i in range(len(words) - 12) if tuple(words[i : i + 13]) in earlier for j in range(i, i + 13)}
        expected.append((str(d), len(words), len(gone), " ".join(w for j, w in enumerate(words) if j not in gone)))
    found = substring_dedup.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in found) == sorted(expected)


@pytest.mark.parametrize("bits, n", [(64, 1), (64, 3), (60, 700), (44, 5000), (9, 400), (3, 5)])
def test_filters_come_back_as_they_were(bits, n):
    rng = np.random.default_rng(bits)
    prints = rng.integers(0, 1 << bits, n, dtype=np.uint64)
    prints = np.r_[prints, prints[: n // 3]]
    found = exact_dedup.CountingQuotientFilter.unpack(exact_dedup.CountingQuotientFilter.of(prints, bits).pack())
    assert dict(zip(found.prints.tolist(), found.counts.tolist())) == Counter(prints.tolist()) and found.bits == bits


def test_texts_of_one_fingerprint_are_told_apart(spark, monkeypatch):
    """Where all texts share a fingerprint, only equal bytes make a group."""
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(5).cast("long"))
    rows = [(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, None), (6, ""), (7, "A")]
    found = exact_dedup.exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in found} == {1: (3, 2), 3: (3, 2), 2: (2, 1), 4: (4, 1), 5: (6, 2), 6: (6, 2), 7: (7, 1)}


def test_filters_merge_without_loss():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 300, 500, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(4) for _ in range(3)]
    filters = [exact_dedup.CountingQuotientFilter.unpack(exact_dedup.CountingQuotientFilter.of(p, 60).pack()) for p in parts]
    whole = exact_dedup.CountingQuotientFilter.merge(filters)
    assert dict(zip(whole.prints.tolist(), whole.counts.tolist())) == Counter(np.concatenate(parts).tolist())


@pytest.mark.parametrize("tile, rounds", [(near_dedup.TILE, near_dedup.HUB_ROUNDS), (3, 1)])
def test_near_copies_against_brute_force(spark, monkeypatch, tile, rounds):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", rounds)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows, line = [], [rng.choice(words) for _ in range(40)]
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 30, 300, 700]))] + line
        for _ in range(rng.randint(1, 5)):
            copy = [rng.choice(words) if rng.random() < 0.02 else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    found = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: find(i) for i in sets}


def test_tiles_count_coordinates_in_common():
    rng = random.Random(12)
    rows = []
    base = rng.sample(range(10**6), 400)
    for k in range(60):
        n = rng.choice([90, 150, 155, 160, 300])
        keys = [x if rng.random() > 0.04 else rng.randrange(10**6) for x in base[:n]]
        rows.append({"side": k % 2, "id": k, "n": len(set(keys)), "component": rng.randrange(30), "keys": sorted(set(keys))[: near_dedup.COORDINATES]})
    for sides in (1, 2):
        table = pa.Table.from_pylist([r | {"side": r["side"] * (sides - 1)} for r in rows])
        expected = set()
        for x in rows:
            for y in rows:
                if x["id"] > y["id"] and x["component"] != y["component"] and (sides == 1 or x["side"] != y["side"]):
                    least = near_dedup._enough(np.array([x["n"]]), np.array([y["n"]]), 0.75)[0, 0]
                    if len(set(x["keys"]) & set(y["keys"])) >= least:
                        expected.add((x["id"], y["id"]))
        found = near_dedup._tile(table, 0.75)
        assert {(r["a"], r["b"]) for r in found.to_pylist()} == expected and expected


def test_recall_of_pairs_at_the_threshold():
    """Signatures of pairs at similarities from 0.75 to 0.8, of few and of many shingles, pass the counts that are asked for."""
    rng = np.random.default_rng(5)
    missed = total = 0
    for n in (20, 100, 150, 170, 250, 600, 3000):
        for _ in range(150):
            share = rng.uniform(0.75, 0.8)
            m = int(rng.integers(int(np.ceil(share * n)), n + 1))
            both = int(np.ceil(share * (n + m) / (1 + share)))
            if both > m:
                continue
            pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
            rng.shuffle(pool)
            x, y = np.sort(pool[:n]), np.sort(np.r_[pool[:both], pool[n : n + m - both]])
            common = len(np.intersect1d(near_dedup.signature(x), near_dedup.signature(y)))
            total += 1
            missed += common < near_dedup._enough(np.array([len(x)]), np.array([len(y)]), 0.75)[0, 0]
    assert total > 900 and missed <= 1


def test_bpe_equals_the_library():
    path = public_tokenizers.path(bpe.VOCABULARY)
    library, own = Tokenizer.from_file(path), bpe.tokenizer(path)
    rng = random.Random(5)
    letters = "abcdefghij'<|>stoen0123 \n\x1c\x85 éÉΣσİßñ中👍½²٣.,-!"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(3000)] + ["a<|endoftext|>B", "ab" * 4000, "", None]
    for t in texts:
        ids = own.encode(t)
        expected = library.encode(t or "", add_special_tokens=False).ids
        assert ids.tolist() == expected and own.decode(ids) == library.decode(expected, skip_special_tokens=False)


def test_bpe_query_against_the_library(spark):
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    found = {r["doc_id"]: r for r in QUERIES["op10_bpe"](spark, DATA).collect()}
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert len(found) == len(docs)
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected = (len(ids), sha256(" ".join(map(str, ids)).encode()).hexdigest(), sha256(decoded.encode()).hexdigest())
        assert tuple(found[r["doc_id"]])[1:] == expected


def test_convolution_and_pooling_against_plain_loops():
    rng = np.random.default_rng(4)
    net = toxicity.Network.fresh(3)
    buckets = np.r_[np.zeros((1, toxicity.FEATURES), np.int32), rng.integers(1, toxicity.BUCKETS, (9, toxicity.FEATURES)).astype(np.int32)]
    texts = [rng.integers(1, 10, n).astype(np.int32) for n in (5, 1, 0, 2, 12)]
    found = toxicity._outputs(net, net.shares(buckets), texts)
    assert np.allclose(found, toxicity._outputs_of(net, buckets, texts))
    for t, out in zip(texts, found):
        x = np.concatenate([net.embeddings[buckets[t]].sum(axis=1), np.zeros((2, toxicity.DIMS))])
        pooled = []
        for f, bias in zip(net.filters, net.biases):
            places = [sum(x[i + j] @ f[j] for j in range(len(f)) if i + j < len(x)) for i in range(len(x))]
            pooled.append(np.maximum(np.max(places, axis=0) + bias, 0))
        assert out == pytest.approx(np.concatenate(pooled) @ net.out + net.out_bias, abs=1e-4)


def test_scores_do_not_take_memory_by_the_length_of_texts(monkeypatch):
    """Filters stood at all places of 64 texts at once: five arrays of 8 numbers for each word."""
    rng = np.random.default_rng(5)
    net = toxicity.Network.fresh(3)
    buckets = np.r_[np.zeros((1, toxicity.FEATURES), np.int32), rng.integers(1, toxicity.BUCKETS, (9, toxicity.FEATURES)).astype(np.int32)]
    shares = net.shares(buckets)
    long = [rng.integers(1, 10, 400_000).astype(np.int32)]
    tracemalloc.start()
    toxicity._outputs(net, shares, long)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6
    for places in (1, 2, 3, 7, 1 << 15):
        monkeypatch.setattr(toxicity, "PLACES", places)
        for _ in range(10):
            ids, starts = toxicity._laid([rng.integers(1, 10, n).astype(np.int32) for n in rng.integers(0, 12, 6)])
            assert np.array_equal(net.maxima(shares, ids, starts), net.pooled(shares, ids, starts)[0])


def test_training_keeps_no_batch_of_the_sample(tmp_path):
    """The whole sample stayed beside the texts and words that were made of it."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(3000)]

    def texts():
        for k in range(40):
            rows = [(str(50 * k + i), i % 2, "en", " ".join(rng.choice(words, 1000))) for i in range(50)]
            yield pa.record_batch([pa.array(x) for x in zip(*rows)], ["id", "toxic", "lang", "text"])

    hashed = list(toxicity._hashed(texts()))
    size, most = sum(b.nbytes for b in hashed), 0
    whole = toxicity._learnable(pa.Table.from_batches(hashed))
    written = str(tmp_path / "sample")
    with pa.OSFile(written, "wb") as file, pa.ipc.new_stream(file, hashed[0].schema) as out:
        for b in hashed:
            out.write_batch(b)
    del b, hashed
    start = pa.total_allocated_bytes()

    def batches():
        nonlocal most
        for b in pa.ipc.open_stream(pa.OSFile(written)):
            most = max(most, pa.total_allocated_bytes() - start)
            yield b

    found = toxicity._learnable(batches())
    assert 0 < most < size / 4
    assert all(np.array_equal(x, y) for x, y in zip(found[0], whole[0])) and found[2] == whole[2]
    assert all(np.array_equal(found[k], whole[k]) for k in (1, 3, 4))


def test_one_step_of_training_follows_the_gradient(monkeypatch):
    """After one batch each weight has moved against the numeric gradient of the loss, by the rate (Adagrad's first step)."""
    rng = np.random.default_rng(6)
    buckets = np.r_[np.zeros((1, toxicity.FEATURES), np.int32), rng.integers(1, 50, (7, toxicity.FEATURES)).astype(np.int32)]
    texts, labels = [rng.integers(1, 8, n).astype(np.int32) for n in (6, 3, 9, 4)], np.array([1, 0, 1, 0], np.float32)
    monkeypatch.setattr(toxicity, "L2", 0.0)
    start = toxicity.Network.fresh(0)
    start.out_bias = float(np.log((labels.mean() + 1e-3) / (1 - labels.mean() + 1e-3)))

    def loss(net):
        p = toxicity._sigmoid(toxicity._outputs(net, net.shares(buckets), texts))
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    moved = toxicity.train(texts, labels, buckets, epochs=1, seed=0)
    checked = 0
    for get in (lambda n: n.out, lambda n: n.filters[1], lambda n: n.filters[2], lambda n: n.embeddings[1:50]):
        before, after = get(start), get(moved)
        for at in rng.permutation(before.size)[:40].tolist():
            place = np.unravel_index(at, before.shape)
            old, d = float(before[place]), 2e-2
            values = []
            for v in (old + d, old - d):
                before[place] = v
                values.append(loss(start))
            before[place] = old
            slope = (values[0] - values[1]) / (2 * d)
            if abs(slope) > 2e-3:
                checked += 1
                assert np.sign(after[place] - old) == -np.sign(slope), (before.shape, place, slope)
    assert checked > 20


def test_marked_articles_and_repeated_runs(spark):
    shared = "<div>one two three four five six seven eight nine</div>"
    pages = [(k, "http://h.org/x", f"<nav>home</nav>{shared}<p>page {k} says &amp; <b>t</b>hat</p><form>mail</form><div class='user comments'>no</div>") for k in range(3)]
    pages += [(5, "http://h.org/y", "<header>top</header><article><h1>A&nbsp;b</h1><p>c\n d<aside>x</aside></p><script>var a='</p>';</script></article>z"), (6, None, None), (6, "x", "")]
    found = {(r["page_id"], r["url"]): r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[k, "http://h.org/x"] for k in range(3)] == [f"{k} says & that" for k in range(3)]
    assert found[5, "http://h.org/y"] == "A b c d" and found[6, None] == found[6, "x"] == ""


@pytest.mark.parametrize("part", [html_text.PART, 4])
def test_repeats_of_a_host_within_articles(spark, monkeypatch, part):
    """A line in most articles of a host goes, texts of copies stay, and an article that only a comment names marks nothing."""
    monkeypatch.setattr(html_text, "PART", part)
    line = "share this story with all your friends on every network"
    own = [" ".join(f"w{k}x{i}" for i in range(30)) for k in range(20)]
    pages = [(k, "http://h.org/x", f"<article><p>{t}</p><p>{line}</p></article>") for k, t in enumerate(own)]
    pages += [(k, "http://pair.org/x", f"<article><p>{own[0]}</p></article>") for k in (30, 31, 32)]
    pages += [(40, "http://two.org/x", f"<div>{own[1]}</div>"), (41, "http://two.org/y", f"<div>{own[1]}</div>")]
    pages += [(50 + k, "http://c.org/x", f"<!-- <article> --><article></article><div>{line}</div><p>{own[k]}</p>") for k in range(3)]
    found = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(20)] == own
    assert found[30] == found[31] == found[32] == own[0] and found[40] == found[41] == own[1]
    assert [found[50 + k] for k in range(3)] == own[:3]


def test_hashes_of_lines_are_those_of_their_words(monkeypatch):
    """Equal words have equal hashes and others other ones, wherever they stand and however long they are."""
    monkeypatch.setattr(words, "_STRETCH", 40)
    rng = random.Random(3)
    line = [bytes(rng.choice(b"ab\xc3\xa4") for _ in range(rng.choice([1, 2, 3, 5, 39, 40, 41, 90]))) for _ in range(500)]
    data = b"".join(w + rng.choice([b" ", b"\n"]) for w in line)[:-1]
    found, starts, ends = words.line_hashes(data)
    assert [data[a:b] for a, b in zip(starts, ends)] == line
    by_word = dict(zip(line, found.tolist()))
    assert [by_word[w] for w in line] == found.tolist() and len(set(by_word.values())) == len(by_word)


def test_shared_runs_against_brute_force():
    rng = random.Random(9)
    for _ in range(20):
        pages = [np.array([rng.randint(0, 2) for _ in range(rng.randint(0, 40))], np.uint64) for _ in range(rng.randint(1, 7))]
        runs = [{tuple(p[i : i + html_text.RUN].tolist()) for i in range(len(p) - html_text.RUN + 1)} for p in pages]
        expected = {r: n for r, n in Counter(r for found in runs for r in found).items() if n > 1}
        found = {tuple(pages[p][a : a + html_text.RUN].tolist()): n for p, a, n in zip(*(x.tolist() for x in html_text.shared_runs(pages)))}
        assert found == expected


@pytest.mark.parametrize("page, text, marked", [
    ('<article><h1 class="article-header">Title here</h1><p>body</p></article>', ["Title here", "body"], True),
    ('<article><div class="search-results-explained">how it works</div></article>', ["how it works"], True),
    ('<article><p class="ad">buy<p>the rest<div>stays</div></article>', ["the rest", "stays"], True),
    ("<main><p>a long text of the page itself</p><article>teaser</article></main>", ["a long text of the page itself"], True),
    ("<main><h1>Title</h1><article>the long text of the article itself</article></main>", ["Title", "the long text of the article itself"], True),
    ("<article>text<article>a reader says</article></article>", ["text"], True),
    ("<script>var t = '<article>';</script><div>menu</div>", ["menu"], False),
    ('<ul><li class="ad">buy<li>kept</ul><div id="cookie-bar">x</div><div class="related posts-list">y</div><div class="header_top-2">z</div>end', ["kept", "end"], False),
    ('<article>a<svg class="i"/>b<iframe src="x"/><p>c<canvas>d</article>', ["ab", "cd"], True),
    ("<article>a<svg><path/><text>no</text></svg >b<!-->c<!-- x --!>d<script>e", ["abcd"], True),
    ('<div>out</div><article><p>one</p><div id="ad-1">buy<p>two</p><p>three</p></article><div>out</div>', ["one", "two", "three"], True),
    ('<nav><a>home</a><article><p>text</p></article>', ["text"], True),
    ('<form id="all"><div>menu</div><article>text<form>mail</form></article></form>', ["text"], True),
    ('<p>text</p><div class="sidebar">a<p>b</p></body>', ["text"], False),
    ('<aside><article>teaser</article></aside><p>text</p>', ["text"], False),
    ('<article><h2 class="widget">Title</h2><div class="main-header">Sub</div>text</article>', ["Title", "Sub", "text"], True),
    ("<article>" + "".join(f'<div class="{c}">no</div>' for c in ("comment-body", "comment-thread", "related-articles", "newsletter-signup", "social-icons", "advertisement-label", "cookie-message", "share-this")) + "text</article>", ["text"], True),
])
def test_blocks(page, text, marked):
    assert html_text.blocks(page) == (text, marked)


def test_broken_pages_take_linear_time():
    """Unmatched ends, unclosed elements and deep nesting: four times the page takes less than ten times as long."""
    for broken in ("</b></div>", "<div class='ad'>x", "<svg>x", "<div><p class='ad'>x"):
        took = []
        for n in (5_000, 20_000):
            began = time.perf_counter()
            html_text.blocks("<article><div><b>" + broken * n)
            took.append(time.perf_counter() - began)
        assert took[1] < 10 * took[0] + 0.2


def test_no_pages(spark):
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string, text string")).count() == 0


def test_pages_against_a_plain_reading(spark):
    found = {r["page_id"]: r["text"] for r in QUERIES["op5_html_text"](spark, DATA).collect()}
    for p in spark.read.parquet(f"{DATA}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", p["html"], re.S)[1]
        assert found[p["page_id"]] == " ".join(html.unescape(re.sub("<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())


def test_language_and_toxicity_on_held_out_rows(spark):
    sf = DATA.replace("0.001", "0.01")
    langs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = [r for r in QUERIES["op4_language"](spark, sf).collect() if r["held_out"]]
    assert sum(langs[r["doc_id"]] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    scored = [(toxic[r["doc_id"]], r["predicted"]) for r in QUERIES["op1_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(a and b for a, b in scored)
    assert 2 * hits >= 0.5 * (sum(a for a, _ in scored) + sum(b for _, b in scored))


def test_each_language_with_toxic_rows_has_a_threshold():
    rng = np.random.default_rng(2)
    labels = np.r_[np.ones(12), np.zeros(200), np.ones(2), np.zeros(30), np.zeros(9)].astype(np.float32)
    langs = ["en"] * 212 + ["es"] * 32 + ["xx"] * 9
    net = toxicity.Network.fresh()
    toxicity.calibrate(net, 3 * labels - 2 + rng.normal(0, 0.1, len(labels)), labels, langs)
    assert set(net.thresholds) == {"en", "es"} and net.scale != 1.0
    assert toxicity._sample_shares({"en": (100_000, 10.0), "es": (50, 10.0)}, 12_000, 40_000_000) == {"es": 1.0, "en": 0.1195}


def test_forward_sums_all_segmentations():
    pieces = langid.Pieces(public_tokenizers.path(langid.VOCABULARY))
    rng = np.random.default_rng(0)
    probability = rng.random((len(pieces.names) + 1, 2))
    ids = {p: i for i, p in enumerate(pieces.names)}

    def total(text):
        if not text:
            return np.ones(2)
        out = np.zeros(2)
        for n in range(1, len(text) + 1):
            if text[:n] in ids:
                out += probability[ids[text[:n]]] * total(text[n:])
            elif n == 1:
                out += probability[-1] * total(text[1:])
        return out

    for word in ("an", "there", "über", "q中x"):
        assert np.allclose(np.exp(langid._long_scores([word], pieces, probability)[0]), total(langid.START + word))
        assert np.allclose(np.exp(langid.word_scores([word], pieces, probability)[0]), total(langid.START + word))


@pytest.mark.parametrize("longest", [1, 7, 40])
def test_long_runs_are_summed_whole(monkeypatch, longest):
    """Runs of any length have the sums over all segmentations, with nothing cut and no start mark inside."""
    monkeypatch.setattr(langid, "LONGEST", longest)
    pieces = langid.Pieces(public_tokenizers.path(langid.VOCABULARY))
    rng = np.random.default_rng(1)
    probability = rng.random((len(pieces.names) + 1, 2)) * 1e-3
    ids = {p: i for i, p in enumerate(pieces.names)}
    most = max(pieces.by_length)
    words = ["".join(rng.choice(list("aeinrst"), n)) for n in (1, 39, 40, 41, 81, 1500)]
    found = langid.word_scores(words, pieces, probability)
    for w, scores in zip(words, found):
        text, alpha, scale = langid.START + w, [np.ones(2)], [np.zeros(2)]
        for end in range(1, len(text) + 1):
            value = sum((alpha[s] * np.exp(scale[s] - scale[-1]) * probability[ids.get(text[s:end], -1)] for s in range(max(0, end - most), end) if text[s:end] in ids or end - s == 1), np.zeros(2))
            alpha.append(value / value.max())
            scale.append(scale[-1] + np.log(value.max()))
        assert np.allclose(scores, np.log(alpha[-1]) + scale[-1])


def test_language_query_against_plain_segmentation(spark):
    """The registered query names for every document the language that plain sums over segmentations name."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(docs)
    pieces = langid.Pieces(model.path)
    ids, most = {p: i for i, p in enumerate(pieces.names)}, max(pieces.by_length)
    known = {}

    def score(run):
        if run not in known:
            text = langid.START + run
            alpha = [np.ones(len(model.languages))]
            for end in range(1, len(text) + 1):
                starts = [s for s in range(max(0, end - most), end) if text[s:end] in ids or end - s == 1]
                alpha.append(sum(alpha[s] * model.probability[ids.get(text[s:end], -1)] for s in starts))
            known[run] = np.log(np.maximum(alpha[-1], 1e-300))
        return known[run]

    found = {r["doc_id"]: r for r in QUERIES["op4_language"](spark, DATA).collect()}
    some = [r for r in docs.collect() if len(r["text"] or "") < 1500][:60]
    assert len(some) > 30 and len(found) == docs.count()
    for r in some:
        words = re.findall(r"[^\W\d_]+", (r["text"] or "").lower())
        total = sum((score(w) for w in words), np.zeros(len(model.languages)))
        assert found[r["doc_id"]]["lang_pred"] == (model.languages[int(np.argmax(total))] if words else "und")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_with_ties_beyond_k_over_several_blocks(spark, monkeypatch, kind):
    monkeypatch.setattr(neighbours, "LEAST_QUERIES", 2)
    monkeypatch.setattr(neighbours, "LEAST_CANDIDATES", 30)
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else rng.integers(-3, 4, 3).astype(float).tolist()) for i in range(200)]
    usable = {i: np.array(v) for i, v in rows if any(v)}
    found = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == {i for i in usable if i % 20 == 0}
    for q, near in found.items():
        expected = sorted((-float(usable[q] @ v), i) for i, v in usable.items() if i != q)[:20]
        assert sorted(near) == [(k + 1, i, -s) for k, (s, i) in enumerate(expected)]
    assert neighbours.nearest(spark.createDataFrame([], f"vec_id long, embedding array<{kind}>, asks string, i int")).count() == 0


def test_vectors_left_out(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.5, 0.5]), (20, [2.0]), (None, [1.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=2).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]


@pytest.mark.parametrize("seed", ["mix", "a", "b"])
def test_mix_meets_targets_past_a_long_document(spark, seed):
    """A long document must not hold up the shorter ones behind it; copies for the rest lie one after another."""
    sizes = [500] * 1000 + [125_000] + [500] * 100
    rows = [(k, "w " * n, None, "a" if k <= 1000 else "b", None) for k, n in enumerate(sizes)]
    found = mixing.mixed(spark.createDataFrame(rows, DOCS).repartition(8), seed=seed).collect()
    assert len(found) == len(rows)
    for source in "ab":
        mine = [r for r in found if r["source"] == source]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 250
        extra = sorted((r["last"], r["size"]) for r in mine if r["extra"])
        at = (mine[0]["copies"] - mine[0]["extra"]) * mine[0]["source_size"]
        for last, size in extra:
            assert last == at + size / 2
            at += size
        assert all(r["copies"] - r["extra"] == mine[0]["copies"] - mine[0]["extra"] and 0 <= r["position"] <= 1 for r in mine if r["copies"])


def test_mix_against_plain_passes(spark):
    """Sizes over many scales, sources whose rest is small, by a plain loop over documents in the order of their hash."""
    rng = random.Random(4)
    rows = [(k, "w " * int(1.6 ** rng.uniform(0, 20)), None, rng.choice("abcd"), None) for k in range(300)]
    found = {r["doc_id"]: r for r in mixing.mixed(spark.createDataFrame(rows, DOCS)).collect()}
    for source in "abcd":
        mine = sorted((hashlib.md5(f"mix:{k}".encode()).hexdigest(), k, len(t.split())) for k, t, _, s, _ in rows if s == source)
        total, target = sum(n for *_, n in mine), found[mine[0][1]]["target"]
        epochs = int(target // total)
        left, taken = target - epochs * total, set()
        for _ in range(mixing.PASSES):
            room, fit = left, [x for x in mine if x[2] <= left and x[1] not in taken]
            for _, k, n in fit:
                if n > room:
                    break
                taken.add(k)
                room -= n
            left = room
        more = [(abs(n - left), h, k) for h, k, n in mine if k not in taken and abs(n - left) < left]
        taken |= {min(more)[2]} if more and epochs < mixing.MAX_REPEATS else set()
        assert all(found[k]["copies"] == epochs + (k in taken) for _, k, _ in mine)
        assert abs(sum(found[k]["taken"] for _, k, _ in mine) - target) <= 0.01 * target
