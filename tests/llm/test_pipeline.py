"""Each stage against a plain reading, on tables with planted copies, near copies and toxic rows, and on odd ones."""

import os
import platform
import random
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from plexweave.llm import bpe, common, exact_dedup, mixing, near_dedup, toxicity, words
from plexweave.llm.oracles import OP6
from tests.conftest import DATA

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"word{i}" for i in range(300)]


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def near(rows):
    """The smallest id of each row's component, by all pairs."""
    sets, parent = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """A folder with documents (copies, near copies, toxic ones) and labels."""
    rng = random.Random(31)
    folder = tmp_path_factory.mktemp("corpus")
    bad = [f"nasty{i}" for i in range(6)]
    rows, labels = [], []
    for k in range(500):
        words = [rng.choice(WORDS) for _ in range(rng.randint(12, 60))]
        toxic = k % 5 == 0
        if toxic:
            for _ in range(4):
                words.insert(rng.randint(0, len(words)), rng.choice(bad))
        rows.append((k, " ".join(words), ("en", "de")[k % 2], f"s{k % 3}", None))
        labels.append((k, 1, int(toxic)))
    for k in range(500, 560):  # copies, and copies with a word changed
        words = rows[rng.randint(1, 80) * 5 + 1][1].split()
        if k % 2:
            words[rng.randint(0, 4)] = "changed"
        rows.append((k, " ".join(words), "en", "s1", None))
    rows += [(560, None, None, None, None), (561, "", "en", "s0", 0), (562, "", "en", "s2", 0), (563, "long " * 20_000, "en", "s0", 9)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, {i for i, _, t in labels if t}


def test_stages_against_plain_readings(spark, corpus):
    folder, rows, toxic = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    clean = [tuple(r) for r in corpus_pipeline.toxicity(spark, docs, folder).collect()]
    assert set(clean) <= set(rows) and len(clean) == len({r[0] for r in clean})
    gone = {r[0] for r in rows} - {r[0] for r in clean}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 4

    once = [tuple(r) for r in corpus_pipeline.exact_dedup(spark, docs, folder).collect()]
    largest = {}
    for r in rows:
        largest[r[1] or ""] = max(r[0], largest.get(r[1] or "", -1))
    assert sorted(r[0] for r in once) == sorted(largest.values()) and set(once) <= set(rows)

    apart = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()]
    component = near([(r[0], r[1]) for r in rows])
    assert sorted(r[0] for r in apart) == sorted(i for i, c in component.items() if i == c) and set(apart) <= set(rows)

    mixed = Counter(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, folder).collect())
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    assert mixed == Counter({i: n for i, n in con.sql(f"select doc_id, copies from ({OP6}) where copies > 0").fetchall()})

    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    coded = {r["doc_id"]: (r["n_tokens"], list(r["ids"])) for r in corpus_pipeline.encoding(spark, docs, folder).collect()}
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        assert coded[r[0]] == (len(ids), ids)


def test_the_whole_run(spark, corpus):
    """The chain keeps one of each group of copies and near copies of clean documents, and drops toxic ones."""
    folder, rows, toxic = corpus
    found = corpus_pipeline.run(spark, folder).collect()
    ids = {r["doc_id"] for r in found}
    text = {r[0]: r[1] for r in rows}
    component = near([(r[0], r[1]) for r in rows])
    assert len(ids & toxic) <= 0.05 * len(toxic) and all((text[i] or "").split() for i in ids)
    kept = Counter(component[i] for i in ids)
    assert max(kept.values()) == 1
    # a source whose target is below its size leaves some of its documents out, but never a whole source
    assert {rows[i][3] for i in ids} == {"s0", "s1", "s2"} and len(ids) > 200
    library = Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    assert all(list(r["ids"]) == library.encode(text[r["doc_id"]], add_special_tokens=False).ids for r in found)


def test_odd_tables(spark, tmp_path):
    """Nulls, empty and repeated rows, clashing names, and empty tables go through every stage."""
    spark.createDataFrame([(None, 1, 1), (1, 0, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    schema = f"{DOCS}, key long, fp string, mix_at int, component string, keys string"
    more = (7, "x", 1, None, "y")
    odd = [(None, None, None, None, None), (None, "a b c", "en", None, 1), (1, "", "en", "s", 0), (1, "other text", None, "s", 1), (1, "other text", None, "s", 1), (2, "w " * 30_000, "xx", "s", 2), (3, "w " * 30_000, "xx", "t", 2)]
    docs = spark.createDataFrame([(*r, *more) for r in odd], schema)
    empty = spark.createDataFrame([], schema)
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        assert found.count() > 0 and (name == "encoding" or found.columns == docs.columns)
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert corpus_pipeline.toxicity(spark, docs, str(tmp_path)).count() == len(odd)
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.exact_dedup(spark, docs, str(tmp_path)).collect()) == ["1", "1", "3", "None", "None"]
    assert sorted(str(r["doc_id"]) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()) == ["1", "1", "1", "2", "None", "None"]
    assert corpus_pipeline.encoding(spark, docs, str(tmp_path)).where("n_tokens = 0").count() == 2


def test_rows_that_repeat_an_id_are_taken_by_themselves(spark):
    rows = [(1, "a", None, "s", 1), (1, "a b", None, "s", 2), (1, "a b", None, "s", 3), (1, "a b", None, "t", 4), (2, "c " * 5, None, "t", 5), (3, None, None, "t", 6)]
    docs = spark.createDataFrame(rows, DOCS)
    taken = Counter()
    for r in mixing.mixed(docs).collect():
        taken[r["doc_id"], r["source"], r["size"]] += r["copies"]
    found = Counter((r["doc_id"], r["source"], len((r["text"] or "").split())) for r in mixing.training_order(docs).collect())
    assert found == +taken


def test_a_task_drops_what_other_stages_left_in_its_worker():
    """Workers outlive stages: a tokenizer and its words stayed beside all later ones."""
    path = public_tokenizers.path(bpe.VOCABULARY)
    ids = pa.array([1, 2], pa.int64())
    texts = pa.record_batch([ids, pa.array(["a b c d e f", "g"]), ids], ["doc_id", "text", "print"])
    sample = pa.record_batch([pa.array(["1"]), pa.array([1], pa.int32()), pa.array(["en"]), pa.array(["a b"])], ["id", "toxic", "lang", "text"])
    known = bpe.tokenizer(path)
    known.encode("some words")
    (signed,) = near_dedup._signed(iter([texts]))
    assert signed["n_shingles"].to_pylist() == [2, 1]
    assert not bpe._loaded and words._caches
    (hashed,) = toxicity._hashed(iter([sample]))
    assert len(hashed["words"][0].as_py()) == 8 and not words._caches
    bpe.tokenizer(path)
    words.hashes()
    assert len(list(exact_dedup._packed(iter([texts.select(["doc_id"])]), 0))) == 1
    assert not bpe._loaded and not words._caches
    bpe.tokenizer(path)
    toxicity._trained((pa.scalar(toxicity.FOLDS),), pa.Table.from_batches([hashed]))
    assert not bpe._loaded
    again = bpe.tokenizer(path)
    assert again is not known and again is bpe.tokenizer(path) and again.encode("some words").tolist() == known.encode("some words").tolist()


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="other libraries have no call for that")
def test_a_task_gives_back_what_the_c_library_holds_unused():
    """Freed arrays under a later one stayed with the worker beside the JVM."""
    resident = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")
    arrays = [np.ones(12_000) for _ in range(500)]
    last = arrays[-20:]
    del arrays
    before = resident()
    with common.worker_memory():
        pass
    assert before - resident() > 20e6 and len(last) == 20
