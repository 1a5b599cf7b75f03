import random

import pytest

from plexweave.functions import geometry
from plexweave.operators import fuzzy, mapping
from plexweave.plans import catalogue as cat
from plexweave.streaming.mapping import map_stream
from tests.conftest import DATA


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind, text", [("gex", cat.GEX_GEOMETRY), ("crispr", cat.CRISPR_GEOMETRY)])
@pytest.mark.parametrize("plan", ["variants", "parts"])
def test_reads_are_scanned_once(spark, tmp_path_factory, monkeypatch, kind, text, plan):
    if plan == "parts":
        monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 0)
    path = str(tmp_path_factory.mktemp("scan") / "read_pairs.parquet")
    cat._reads(spark, DATA, kind).write.parquet(path)
    reads = spark.read.parquet(path)
    for window in (1, 5):
        flags = mapping.flagged(reads, geometry.parse(text), cat._libraries(spark, DATA, kind), window)
        scans = [line for line in plan_of(flags).splitlines() if "Relation" in line and "r1_qual" in line]
        assert len(scans) == 1


@pytest.mark.parametrize("exact", [False, True])
@pytest.mark.parametrize("plan", ["variants", "parts", "halves", "misses"])
def test_lookups_against_brute_force(spark, plan, exact):
    rng = random.Random(3)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    reference = [letters(7, "AC") for _ in range(25)] + [None]
    reference += reference[:3]
    reads = [letters(rng.randint(5, 11), "ACN" if rng.random() < 0.3 else "AC") for _ in range(300)] + [None, ""]
    distance = lambda a, b: sum(x != y for x, y in zip(a, b))

    def match(segment):
        own = [i for i, r in enumerate(reference) if r == segment]
        if own or exact:
            return min(own, default=None)
        near = {r: i for i, r in reversed(list(enumerate(reference))) if r and distance(r, segment) == 1}
        return next(iter(near.values())) if len(near) == 1 else None

    expected = []
    for read in reads:
        hit = (None, None)
        for s in fuzzy.offsets(1):
            if read and 1 + s >= 0 and 1 + s + 7 <= len(read) and (i := match(read[1 + s : 8 + s])) is not None:
                hit = (i, s)
                break
        expected.append((str(read), *map(str, hit)))
    rows = spark.createDataFrame([(r,) for r in reads], "read string")
    known = spark.createDataFrame(list(enumerate(reference)), "idx long, seq string")
    found = fuzzy.lookup(rows, "hit", rows["read"], 1, known, 7, 1, exact, plan).collect()
    assert sorted((str(r["read"]), str(r["hit"]), str(r["hit_shift"])) for r in found) == sorted(expected)


def test_split_halves_by_either_index(spark, monkeypatch):
    reads, library = cat._reads(spark, DATA).select("read_id", "r2_seq"), cat._libraries(spark, DATA).gex
    run = lambda: sorted(fuzzy.split_match(reads, "hit", reads["r2_seq"], 0, library, 50, 1).drop("r2_seq").collect(), key=str)
    one = run()
    monkeypatch.setattr(fuzzy, "BROADCAST_ROWS", 0)
    assert run() == one and any(r["hit"] is not None for r in one)
    monkeypatch.setattr(fuzzy, "BROADCAST_SEQUENCES", 10)
    assert run() == one


def test_a_stream_maps_as_a_table_does(spark, tmp_path):
    reads = cat._reads(spark, DATA).drop("read_id")
    reads.repartition(3).write.parquet(str(tmp_path / "in"))
    shape, libs = geometry.parse(cat.GEX_GEOMETRY), cat._libraries(spark, DATA)
    stream = spark.readStream.schema(reads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    map_stream(stream, shape, libs, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    keys = ["alias", "barcode", "umi", "index"]
    found = spark.read.parquet(str(tmp_path / "out")).groupBy(keys).sum("n_reads").collect()
    expected = mapping.records(mapping.flagged(reads, shape, libs)).collect()
    assert {tuple(r) for r in found} == {tuple(r[k] for k in [*keys, "n_reads"]) for r in expected}
    assert len(list((tmp_path / "out").glob("batch=*"))) == 3


def test_probes_and_geometry_must_go_together(spark):
    libs = cat._libraries(spark, DATA)
    with pytest.raises(ValueError, match="no probes"):
        mapping.flagged(cat._reads(spark, DATA), geometry.parse(cat.GEX_GEOMETRY), mapping.Libraries(libs.whitelist, libs.gex))
    with pytest.warns(UserWarning, match="not used"):
        mapping.flagged(cat._reads(spark, DATA), geometry.parse("[barcode][umi:12]|[gex]"), libs)


@pytest.mark.parametrize("most", [2_000_000, 3])
def test_split_halves_against_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(fuzzy, "BROADCAST_SEQUENCES", most)
    rng = random.Random(11)
    letters = lambda n, of="AC": "".join(rng.choice(of) for _ in range(n))
    library = [letters(12) for _ in range(14)]
    library += [library[0], None]
    reads = [letters(1 + k % 2) + "".join(c if rng.random() < 0.85 else rng.choice("ACN") for c in rng.choice(library[:14])) + letters(2) for k in range(400)] + [None, "", "ACAC"]
    distance = lambda a, b: sum(x != y for x, y in zip(a, b))

    def half(segment, cut):
        known = [(i, r[cut]) for i, r in enumerate(library) if r]
        own = [i for i, r in known if r == segment]
        if own:
            return min(own)
        near = {r: i for i, r in reversed(known) if distance(r, segment) == 1}
        return next(iter(near.values())) if len(near) == 1 else None

    def match(segment):
        a, b = half(segment[:6], slice(6)), half(segment[6:], slice(6, 12))
        if a is not None and b is not None:
            return a if a == b else None
        one = a if a is not None else b
        return one if one is not None and distance(segment, library[one]) <= 3 else None

    expected = []
    for read in reads:
        hits = [match(read[1 + s : 13 + s]) for s in fuzzy.offsets(1) if read and len(read) >= 13 + s]
        expected.append((str(read), str(next((h for h in hits if h is not None), None))))
    known = spark.createDataFrame(list(enumerate(library)), "idx long, seq string")
    rows = spark.createDataFrame([(r,) for r in reads], "read string")
    found = fuzzy.split_match(rows, "hit", rows["read"], 1, known, 12, 1).collect()
    assert sorted((str(r["read"]), str(r["hit"])) for r in found) == sorted(expected) and len({h for _, h in expected}) > 5


@pytest.mark.parametrize("kind, text", [("gex", cat.GEX_GEOMETRY), ("crispr", cat.CRISPR_GEOMETRY)])
def test_large_libraries_move_reads_once_and_map_as_small_ones_do(spark, tmp_path_factory, monkeypatch, kind, text):
    path = str(tmp_path_factory.mktemp("move") / "read_pairs.parquet")
    cat._reads(spark, DATA, kind).write.parquet(path)
    reads = spark.read.parquet(path)
    keys = ["feature", "feature_end", "barcode", "umi", "alias", *mapping.REASONS]
    flags = lambda: mapping.flagged(reads, geometry.parse(text), cat._libraries(spark, DATA, kind))
    small = flags().select("read_id", *keys).collect()
    n = 10 if kind == "gex" else 100  # whitelist, anchors and probes stay broadcast
    monkeypatch.setattr(fuzzy, "BROADCAST_SEQUENCES", n)
    assert sorted(flags().select("read_id", *keys).collect(), key=str) == sorted(small, key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = flags().groupBy("alias", "feature", "barcode", "umi").count()
        moved.collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = moved._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in plan.splitlines() if "FileScan" in x and "r2_seq" in x]) == 1


@pytest.mark.parametrize("n", [None, 10, 10_000])
def test_thirds_find_what_halves_find(spark, n):
    rng = random.Random(5)
    letters = lambda k, of="AC": "".join(rng.choice(of) for _ in range(k))
    known = spark.createDataFrame([(i, letters(8)) for i in range(60)], "idx long, seq string")
    segments = spark.createDataFrame([(s,) for s in {letters(8, "ACN") for _ in range(400)}], "seg string")
    run = lambda n: sorted(map(tuple, fuzzy.match_by_halves(segments, known, 8, n).collect()))
    by_misses = sorted(map(tuple, fuzzy.match_by_misses(segments, known, 8).collect()))
    assert run(n) == by_misses and by_misses
