import gzip
import random
import tarfile

import pytest
import zstandard
from pyspark.sql import functions as F

from plexweave.functions import sequence
from plexweave.session import spread
from plexweave.sources import download, fastq, libraries, sinks


def test_fastq_pairs(spark, tmp_path):
    (tmp_path / "a.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nTTTT\n+\n####\n")
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@r1\nCC\n+\nII\n@r2\nGG\n+\nII\n")
    rows = libraries.reads(spark, [str(tmp_path / "a.fastq"), str(tmp_path / "b.fastq.gz")]).collect()
    assert [(r["r1_seq"], r["r2_seq"], r["r1_qual"]) for r in rows] == [("ACGT", "CC", "IIII"), ("TTTT", "GG", "####")]
    with pytest.raises(ValueError):
        libraries.reads(spark, ["a.fastq"])


def test_libraries(spark, tmp_path):
    (tmp_path / "p.txt").write_text("AAAA\tAAAA\tBC001\nCCCC\tAAAA\tBC002\n")
    assert [r["alias"] for r in libraries.probe_barcodes(spark, str(tmp_path / "p.txt"), "2$").collect()] == ["BC002"]
    (tmp_path / "f.tsv").write_text("u1 g1\nu2\tg2\n")
    assert [tuple(r) for r in libraries.features(spark, str(tmp_path / "f.tsv")).orderBy("index").collect()] == [(0, "g1"), (1, "g2")]
    (tmp_path / "w.txt").write_text("ACGT\nAC\n")
    with pytest.raises(ValueError):
        libraries.strict_whitelist(spark, str(tmp_path / "w.txt"))


@pytest.mark.parametrize("name", ["plain.tsv", "hidden_gzip.tsv", "hidden_zstd.tsv", "named.gz"])
def test_compression_is_told_by_content(spark, tmp_path, name):
    data = "p1\tg1\tACGT\n\np2\tg2\t\np3\tg1\tTTTT\n".encode()
    if "gz" in name:
        data = gzip.compress(data[:9]) + gzip.compress(data[9:])
    elif "zstd" in name:
        data = zstandard.compress(data[:9]) + zstandard.compress(data[9:])
    (tmp_path / name).write_bytes(data)
    found = libraries.gex_library(spark, str(tmp_path / name)).orderBy("idx").select("idx", "probe_name", "gene_name", "seq").collect()
    assert [tuple(r) for r in found] == [(0, "p1", "g1", "ACGT"), (1, "p2", "g2", None), (2, "p3", "g1", "TTTT")]


def test_matrix(spark, tmp_path):
    counts = spark.createDataFrame([(0, "g1", 2), (5, "g2", 3), (5, "g1", 1)], "barcode long, gene string, count long")
    sinks.write_matrix(counts, str(tmp_path / "m"), bc_len=4, suffix="X")
    lines = [line for p in sorted((tmp_path / "m/matrix.mtx.gz").glob("part-*")) for line in gzip.open(p, "rt").read().splitlines()]
    assert lines == ["%%MatrixMarket matrix coordinate integer general", "2 2 3", "1 1 2", "1 2 1", "2 2 3"]


def test_sequences(spark):
    rows = spark.createDataFrame([("ACGTN", "ACGAA", "I+*"), ("TTTTT", "TTTTT", "III")], "a string, b string, q string")
    pack = sequence.encode
    found = rows.select(
        sequence.decode(pack(F.col("a")), 5), sequence.packed_hamming(pack(F.col("a")), pack(F.col("b"))), sequence.hamming(F.col("a"), F.col("b")),
        sequence.quality_passes(F.col("q"), 0, 3), sequence.quality_passes(F.col("q"), 0, 4),
    ).collect()
    assert [tuple(r) for r in found] == [("ACGTA", 1, 2, False, True), ("TTTTT", 0, 0, True, True)]


def test_unpack(tmp_path):
    (tmp_path / "top").mkdir()
    (tmp_path / "top/x.txt").write_text("1")
    (tmp_path / "top/._x.txt").write_text("2")
    with tarfile.open(tmp_path / "r.tar.gz", "w:gz") as t:
        t.add(tmp_path / "top", "top")
    out = tmp_path / "out"
    assert download.unpack(str(tmp_path / "r.tar.gz"), str(out), "v1") and not download.unpack(str(tmp_path / "r.tar.gz"), str(out), "v1")
    assert (out / "x.txt").read_text() == "1" and not (out / "._x.txt").exists()


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def write_pairs(folder, name, n, seed, end="\n"):
    """Two files of `n` records whose lengths differ, and what they hold."""
    rng = random.Random(seed)
    letters = lambda k, of="ACGTN": "".join(rng.choice(of) for _ in range(k))
    rows = []
    for _ in range(n):
        a, b = letters(rng.randint(0, 40)), letters(rng.randint(1, 90))
        rows.append((a, b, letters(len(a), "@+I#"), letters(len(b), "@+I#")))
    for side in (0, 1):
        text = "".join(f"@r{k} {side}{end}{r[side]}{end}+{'again' * (k % 2)}{end}{r[side + 2]}{end}" for k, r in enumerate(rows))
        (folder / f"{name}_R{side + 1}.fastq").write_text(text + (end if side else ""), newline="")
    return [str(folder / f"{name}_R1.fastq"), str(folder / f"{name}_R2.fastq")], rows


def test_one_pair_of_files_is_read_by_many_tasks(spark, tmp_path, small_blocks):
    first, rows = write_pairs(tmp_path, "a", 300, 1)
    second, more = write_pairs(tmp_path, "b", 40, 2, "\r\n")
    assert spark.read.text(first[0]).rdd.getNumPartitions() > 10
    found = libraries.reads(spark, first + second)
    expected = [(*r, 0) for r in rows] + [(*r, 1) for r in more]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
    lines = fastq.numbered_lines(spark, [first[1]]).collect()
    assert [x["value"] for x in sorted(lines, key=lambda x: x["line"])] == open(first[1]).read().splitlines()


def test_faults_of_sequence_files(spark, tmp_path, small_blocks):
    (r1, r2), _ = write_pairs(tmp_path, "a", 60, 3)
    text = open(r1).read()
    faults = {"cut off": text[: text.rindex("\n", 0, -1)], "not a FASTQ": text.replace("+\n", "-\n", 1), "differ": "".join(text.splitlines(True)[:-4]), "neither": text.replace("\n@r7 ", "\n#r7 ")}
    for what, changed in faults.items():
        (tmp_path / "bad.fastq").write_text(changed)
        with pytest.raises(Exception, match=what):
            libraries.reads(spark, [str(tmp_path / "bad.fastq"), r2]).collect()


def test_files_for_either_reader(spark, tmp_path):
    (r1, r2), rows = write_pairs(tmp_path, "a", 20, 4)
    for name in ("x.fastq.gz", "hidden.fastq"):  # gzip by its name, and by its bytes only
        with gzip.open(tmp_path / name, "wt") as f:
            f.write(open(r2).read().removesuffix("\n"))
        assert fastq.is_text(spark, str(tmp_path / name)) == name.endswith("gz")
        assert sorted(map(tuple, libraries.reads(spark, [r1, str(tmp_path / name)]).collect())) == sorted((*r, 0) for r in rows)
    for name in ("a.fa", "b.fa"):
        (tmp_path / name).write_text(">r\nAC\nGT\n>s\nT\n")
    found = libraries.reads(spark, [str(tmp_path / "a.fa"), str(tmp_path / "b.fa")]).collect()
    assert sorted((r["r1_seq"], r["r2_seq"], r["r1_qual"]) for r in found) == [("ACGT", "ACGT", None), ("T", "T", None)]


def test_small_tables_are_spread_over_all_cores_and_larger_ones_read_in_place(spark, tmp_path):
    path = str(tmp_path / "reads.parquet")
    spark.range(1000).coalesce(1).write.parquet(path)
    rows = spark.read.parquet(path)
    assert spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert sorted(r["id"] for r in libraries.reads(spark, [path]).collect()) == list(range(1000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
        assert "Repartition" not in spread(rows)._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
