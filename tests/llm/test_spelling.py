"""Spelling variants against plain readings, in one shard and in many."""

import random
import re
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pytest

from plexweave.llm import spelling
from plexweave.llm.oracles import OP12
from plexweave.llm.queries import QUERIES
from tests.conftest import DATA


def distance_is_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_groups(counts, ratio=10):
    """word: form, root, n, n_near, form_n by all pairs."""
    out = {}
    for w, n in counts.items():
        near = [(-m, v) for v, m in counts.items() if distance_is_one(w, v)]
        best = min(near, default=None)
        form = best[1] if best and -best[0] >= ratio * n else None
        out[w] = [form, w, n, len(near), -best[0] if form else None]
    for row in out.values():
        while out[row[1]][0]:
            row[1] = out[row[1]][0]
    return {w: tuple(row) for w, row in out.items()}


def drawn(n, letters="abé", most=7, seed=3):
    rng = random.Random(seed)
    return {"".join(rng.choice(letters) for _ in range(rng.randint(0, most))): rng.choice([2, 2, 3, 5, 20, 21, 210, 4000]) for _ in range(n)}


def test_automaton_against_all_pairs():
    counts = drawn(500)
    words = sorted(w.encode("latin-1") for w in counts)
    whole = spelling.Shard.unpack(spelling.Shard(words, [1] * len(words)).pack())
    others = [*words, *(w.encode("latin-1") for w in drawn(300, "abcé", 9, 4))]
    for w in others:
        expected = [v for v in words if distance_is_one(w, v)]
        assert sorted(whole.ahead.word(k) for k in whole.near(w)) == expected
        assert sorted(whole.ahead.word(k) for k in whole.ahead.near(w)) == expected
    assert spelling.Shard([b"abc"], [2]).near(b"abd") == [0] and spelling.Shard([b""], [2]).near(b"x") == [0]


def test_one_edit():
    words = [w.encode("latin-1") for w in drawn(120, most=5)]
    assert all(spelling.one_edit(a, b) == distance_is_one(a, b) for a in words for b in words)


@pytest.mark.parametrize("shard, round_bytes", [(250_000, 48_000_000), (7, 2_000), (1, 1)])
def test_groups_against_all_pairs(spark, monkeypatch, shard, round_bytes):
    counts = drawn(400 if shard > 1 else 12, "abcé", 8)
    monkeypatch.setattr(spelling, "SHARD_WORDS", max(shard, len(counts) // 6))
    monkeypatch.setattr(spelling, "ROUND_BYTES", round_bytes if shard > 1 else 1)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = spelling.variant_groups(words).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found} == plain_groups(counts) and len(found) == len(counts)


def test_long_chains_end_at_their_root(spark):
    words = [("abcdefgh"[:k] + "x" * (10 - k), 2 * 11**k) for k in range(9)]
    found = {r["word"]: r for r in spelling.variant_groups(spark.createDataFrame(words, "word string, n long")).collect()}
    assert {r["root"] for r in found.values()} == {"abcdefghxx"} and found["abcdefghxx"]["form"] is None


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lowered):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += len(run) >= 7
    return {w: n for w, n in out.items() if n >= 2}


def test_odd_tables(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD_WORDS", 5)
    rng = random.Random(9)
    names = ["Überraschung", "überraschung", "straßenbahn", "colours", "colour", "x×yabcdefg", "ÀÉabcdefg", "z" * 5000]
    rows = [(k % 40, " ".join(rng.choice(names) for _ in range(30))) for k in range(60)]
    rows += [(None, None), (None, "colours"), (3, ""), (4, "y" * 200_000), (5, "y" * 200_000), *[(6, "repeated repeated")] * 2]
    docs = spark.createDataFrame([(i, t, None) for i, t in rows], "doc_id long, text string, word string")
    found = spelling.word_counts(docs)
    assert {r["word"]: r["n"] for r in found.collect()} == plain_counts(rows)
    whole = spelling.spelling_variants(docs).collect()
    expected = plain_groups(plain_counts(rows))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in whole} == expected
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{DATA}/documents.parquet'")
    order = lambda x: x[sorted(x.columns)].astype(object).where(x.notna(), None).sort_values("word").reset_index(drop=True)
    found, expected = QUERIES["op12_spelling"](spark, DATA).toPandas(), con.sql(OP12).df()
    pd.testing.assert_frame_equal(order(found), order(expected), check_dtype=False)
