"""The filter audit against plain loops over orders, with runs of copies over many ranges."""

from itertools import permutations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plexweave.llm import filter_audit
from plexweave.llm.oracles import OP13
from plexweave.llm.queries import QUERIES
from tests.conftest import DATA

LONG = " ".join(f"w{i}" for i in range(120))
TEXTS = [LONG, LONG + " #", LONG.upper(), "same " * 150, "", "A", "a|b", "x y \x0bz", LONG + " more", "WÉ" * 90]


def fails(text, doc_id, rows):
    words = "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ")
    words = [w for w in words if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    out = {"A"} if len(words) < 100 else set()
    out |= {"B"} if 100 * len(set(words)) < 80 * len(words) else set()
    out |= {"C"} if 100 * capitals > 10 * len(text) else set()
    out |= {"D"} if any(c in "#$%&*|" for c in text) else set()
    return out | ({"E"} if doc_id is not None and any((t or "") == text and i is not None and i < doc_id for i, t, _ in rows) else set())


def plain(rows, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = [(i, lang or "", fails(text or "", i, rows)) for i, text, lang in rows]
    out = {}
    for part in {p for _, p, _ in docs}:
        own = [(i, f) for i, p, f in docs if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                failing = sum(f in x[1] for x in own)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(x[1] == {f} for x in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(shapley[f])
    return {k: tuple(v) for k, v in out.items()}


NAMES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


@pytest.mark.parametrize("partitions", [1, 4, 13])
@pytest.mark.parametrize("one_print", [False, True])
def test_audit_against_plain_loops(spark, monkeypatch, partitions, one_print):
    """With one fingerprint for all texts, runs of several texts lie over the same ranges."""
    rows = [(k, TEXTS[k * k % len(TEXTS)], ("en", "de", None, "")[k % 4]) for k in range(60)]
    rows += [(100 + k, TEXTS[8], "en") for k in range(40)]  # a hot text
    rows += [(7, TEXTS[4], "en"), (7, TEXTS[4], "en"), (None, TEXTS[4], "fr"), (None, None, None), (5, None, "de"), (-1, "LONE", "de"), (200, LONG * 400, "en")]
    labels = [(k, k % 2, int(k % 3 == 0)) for k in range(0, 150, 2)] + [(4, 1, None), (4, 0, 1), (None, 1, 1), (6, None, None)]
    if one_print:
        monkeypatch.setattr(filter_audit.F, "xxhash64", lambda *c: F.length(c[0]).cast("long") * 0)
    docs = spark.createDataFrame([(i, t, p, "x") for i, t, p in rows], "doc_id long, text string, lang string, mask string").repartition(3)
    marks = spark.createDataFrame([(*x, "y") for x in labels], "doc_id long, quality int, toxic int, part string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = filter_audit.filter_audit(docs, marks).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in NAMES) for r in found} == plain(rows, labels)


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(docs, labels).count() == 0
    assert filter_audit.filter_audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).count() == 600


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    keys = ["part", "filter_order", "step"]
    order = lambda x: x[[*keys, *NAMES]].sort_values(keys).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(QUERIES["op13_filter_audit"](spark, DATA).toPandas()), order(con.sql(OP13).df()), check_dtype=False)
