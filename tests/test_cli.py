"""The command line from files to files, and the sinks and sources it goes through."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from plexweave import cli
from plexweave.functions.sequence import decode, encode
from plexweave.operators import ibu
from plexweave.plans import workflow
from plexweave.sources import libraries, sinks

RNG = random.Random(21)
SEQ = lambda n: "".join(RNG.choice("ACGT") for _ in range(n))
BARCODES, GENES = [SEQ(16) for _ in range(4)], [SEQ(50) for _ in range(6)]
GUIDES = [(f"g{k}", SEQ(9 + k % 2), SEQ(20)) for k in range(4)]
PROBES = [(SEQ(8), "AAAACCCC", name) for name in ("BC001", "BC002")]


def fastq(path, sequences, opener=open):
    with opener(path, "wt") as f:
        f.writelines(f"@r{k}\n{s}\n+\n{'I' * len(s)}\n" for k, s in enumerate(sequences))


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "white.txt").write_text("\n".join(BARCODES) + "\n")
    with gzip.open(d / "genes.tsv.gz", "wt") as f:
        f.writelines(f"p{k}\tG{k // 2}\t{s}\n" for k, s in enumerate(GENES))
    (d / "guides.tsv").write_text("".join("\t".join(g) + "\n" for g in GUIDES))
    (d / "probes.txt").write_text("".join("\t".join(p) + "\n" for p in PROBES))
    pairs, crispr = [], []
    for k in range(600):
        b, u, g, p = RNG.choice(BARCODES), SEQ(12), RNG.choice(GENES), RNG.choice(PROBES)[0]
        pairs.append((b + u, g + SEQ(18) + p))
        _, anchor, spacer = RNG.choice(GUIDES)
        crispr.append((b + u, p + anchor + spacer))
    pairs += [("T" * 28, GENES[0] + "A" * 26), (BARCODES[0], "A" * 76)]
    fastq(d / "a_R1.fastq", [x for x, _ in pairs[:300]])
    fastq(d / "a_R2.fastq", [y for _, y in pairs[:300]])
    fastq(d / "b_R1.fq.gz", [x for x, _ in pairs[300:]], gzip.open)
    fastq(d / "b_R2.fq.gz", [y for _, y in pairs[300:]], gzip.open)
    fastq(d / "c_R1.fastq", [x for x, _ in crispr])
    fastq(d / "c_R2.fastq", [y for _, y in crispr])
    return d, pairs, crispr


def text(folder):
    return [line for p in sorted(folder.glob("part-*")) for line in (gzip.open(p, "rt") if p.suffix == ".gz" else open(p)).read().splitlines()]


def expected_counts(pairs):
    genes = {s: f"G{k // 2}" for k, s in enumerate(GENES)}
    out = {}
    for b, u, g, p in {(x[:16], x[16:], y[:50], y[68:]) for x, y in pairs[:600]}:
        key = (dict((s, a) for s, _, a in PROBES)[p], b, genes[g])
        out[key] = out.get(key, 0) + 1
    return out


def test_gex_workflow(spark, files):
    d, pairs, _ = files
    inputs = [str(d / n) for n in ("a_R1.fastq", "a_R2.fastq", "b_R1.fq.gz", "b_R2.fq.gz")]
    flags = ["-c", str(d / "genes.tsv.gz"), "-w", str(d / "white.txt"), "-p", str(d / "probes.txt"), "--min-ibu-records", "10", "--skip-umi"]
    cli.main(["workflow", "gex", *inputs, *flags, "-o", str(d / "out"), "-F", "tsv", "--keep-ibu"])
    out = d / "out"
    found = {}
    for line in text(out / "counts"):
        barcode, gene, n = line.split("\t")
        found[(*reversed(barcode.split("-")), gene)] = int(n)
    assert found == expected_counts(pairs)
    stats = json.loads((out / "stats/mapping.json").read_text())
    assert (stats["total_reads"], stats["mapped_reads"], stats["missing_whitelist"]) == (602, 600, 1)
    library = {x["kind"]: x for x in json.loads((out / "stats/library.json").read_text())}
    assert (library["gex"]["mate"], library["gex"]["position"], library["gex"]["total_elem"]) == (2, 0, 6) and library["probe"]["position"] == 68
    assert [x["reads"] for x in json.loads((out / "stats/run.json").read_text())] == [300, 302]
    assert [line.split("\t") for line in text(out / "metadata/features.tsv")] == [[f"p{k}", f"G{k // 2}"] for k in range(6)]
    assert text(out / "reads")[0].split("\t") == ["alias", "barcode", "n_umis", "n_reads"]
    assert sorted(p.name for p in (out / "ibu").glob("alias=*")) == ["alias=BC001", "alias=BC002"] and (out / ".done").exists()
    timings = (out / ".timings.tsv").read_text().splitlines()
    assert timings[0] == "ibu_name\tmodule\telapsed" and {t.split("\t")[1] for t in timings[1:]} == {"Mapping", "Records", "ReadsDump", "Counting", "DropletFilter"}
    assert "mapped 600 of 602 reads" in (out / "plexweave.log").read_text()
    with pytest.raises(FileExistsError):
        cli.main(["workflow", "gex", *inputs, *flags, "-o", str(out)])
    cli.main(["workflow", "gex", *inputs, *flags, "-o", str(out), "-f", "--skip-reads", "--no-filter"])
    assert not (out / "ibu").exists() and not (out / "reads").exists()
    head = text(out / "counts/BC001/matrix.mtx.gz")
    mine = [k for k in expected_counts(pairs) if k[0] == "BC001"]
    assert head[1] == f"{len({k[2] for k in mine})} {len({k[1] for k in mine})} {len(mine)}" and len(head) == 2 + len(mine)
    assert sorted(text(out / "counts/BC001/barcodes.tsv.gz")) == sorted({f"{k[1]}-BC001" for k in mine})
    with pytest.raises(ibu.EmptyStreamError):
        cli.main(["workflow", "gex", *inputs, *flags, "--min-ibu-records", "100000", "-o", str(d / "none")])


def test_crispr_workflow_and_records(spark, files, capsys):
    d, _, crispr = files
    flags = ["-c", str(d / "guides.tsv"), "-w", str(d / "white.txt"), "-p", str(d / "probes.txt"), "--probe-regex", "1$", "--min-ibu-records", "1"]
    inputs = [str(d / "c_R1.fastq"), str(d / "c_R2.fastq")]
    cli.main(["workflow", "crispr", *inputs, *flags, "-o", str(d / "guides"), "--keep-ibu", "--fdr-threshold", "1", "--min-umi-cells", "1", "--min-umi-guides", "1"])
    kept = [(x[:16], x[16:]) for x, y in crispr if y.startswith(PROBES[0][0])]
    records = spark.read.parquet(str(d / "guides/ibu"))
    assert records.agg({"n_reads": "sum"}).first()[0] == len(kept) and {r["alias"] for r in records.collect()} == {"BC001"}
    assert spark.read.parquet(str(d / "guides/assignments")).count() == len({(x[:16], y[8:]) for x, y in crispr if y.startswith(PROBES[0][0])})
    cli.main(["map", "crispr", *inputs, *flags, "-o", str(d / "mapped")])
    assert spark.read.parquet(str(d / "mapped/ibu")).count() == records.count()
    one = [str(d / "mapped/ibu")]
    cli.main(["ibu", "view", "-i", *one, "-o", str(d / "v"), "--decode"])
    lines = text(d / "v")
    assert lines[:5] == ibu.header(16, 12) and {tuple(x.split("\t")[:2]) for x in lines[5:]} == set(kept)
    capsys.readouterr()
    cli.main(["ibu", "view", "-i", *one, "--decode", "--skip-header"])
    assert sorted(capsys.readouterr().out.splitlines()) == sorted(lines[5:])
    cli.main(["ibu", "view", "-i", *one, "-o", str(d / "h"), "--header-only"])
    assert text(d / "h") == ibu.header(16, 12)
    cli.main(["ibu", "sort", "-i", *one, "-o", str(d / "s")])
    rows = [tuple(r)[:3] for r in spark.read.parquet(str(d / "s")).select("barcode", "umi", "index").collect()]
    assert rows == sorted(rows)
    cli.main(["ibu", "cat", "-i", *one, *one, "-o", str(d / "twice")])
    assert spark.read.parquet(str(d / "twice")).count() == 2 * records.count()
    cli.main(["ibu", "umi", "-i", *one, "-o", str(d / "umi"), "-l", str(d / "umi.json")])
    assert json.loads((d / "umi.json").read_text())["total"] == len(kept)
    cli.main(["ibu", "reads", "-i", *one, "-w", str(d / "white.txt"), "-o", str(d / "r"), "--encoded", "--no-header"])
    assert sum(int(x.split("\t")[2]) for x in text(d / "r")) == len(kept) and all(x.split("\t")[0].isdigit() for x in text(d / "r"))
    (d / "f.tsv").write_text("".join(f"{n}\tgene{k % 2}\n" for k, (n, *_) in enumerate(GUIDES)))
    cli.main(["ibu", "count", "-i", *one, "-f", str(d / "f.tsv"), "-o", str(d / "c"), "-s", "S9"])
    assert {x.split("\t")[1] for x in text(d / "c")} == {"gene0", "gene1"} and all(x.split("\t")[0].endswith("-S9") for x in text(d / "c"))
    cli.main(["ibu", "count", "-i", *one, "-f", str(d / "f.tsv"), "-o", str(d / "m"), "--mtx"])
    assert text(d / "m/matrix.mtx.gz")[0].startswith("%%MatrixMarket")
    with pytest.raises(ValueError):
        cli.main(["ibu", "count", "-i", *one, "-o", str(d / "x"), "--mtx"])


def test_sources_and_sinks(spark, files, tmp_path):
    d, pairs, _ = files
    assert [(r["idx"], r["probe_name"], r["gene_name"], r["seq"]) for r in libraries.gex_library(spark, str(d / "genes.tsv.gz")).orderBy("idx").collect()] == [(k, f"p{k}", f"G{k // 2}", s) for k, s in enumerate(GENES)]
    assert [tuple(r) for r in libraries.guide_library(spark, str(d / "guides.tsv")).orderBy("idx").select("name", "anchor", "protospacer").collect()] == GUIDES
    assert {r["seq"] for r in libraries.whitelist(spark, str(d / "white.txt")).collect()} == set(BARCODES)
    rows = libraries.reads(spark, [str(d / "a_R1.fastq"), str(d / "a_R2.fastq")])
    rows.drop("input_id").write.parquet(str(tmp_path / "reads.parquet"))
    again = libraries.reads(spark, [str(tmp_path / "reads.parquet")])
    assert {(r["r1_seq"], r["r2_seq"], r["input_id"]) for r in again.collect()} == {(x, y, 0) for x, y in pairs[:300]}
    (tmp_path / "f.tsv").write_text("one\n")
    with pytest.raises(Exception, match="no such column"):
        libraries.features(spark, str(tmp_path / "f.tsv")).collect()
    lines = spark.createDataFrame([("x",), ("y",)], "value string").coalesce(1)
    for name in ("plain", "t.gz"):
        sinks.write_text(lines, str(tmp_path / name))
        assert [r["value"] for r in spark.read.text(str(tmp_path / name)).collect()] == ["x", "y"]
    with pytest.raises(Exception, match="already exists"):
        sinks.write_text(lines, str(tmp_path / "plain"))
    packed = spark.createDataFrame([(BARCODES[0],)], "s string")
    assert packed.select(decode(encode(packed["s"]), 16)).first()[0] == BARCODES[0]
    suffixed = workflow.suffixed(spark.createDataFrame([("ACGT", "output"), ("ACGT", "BC1")], "barcode string, alias string"))
    assert sorted(r["barcode"] for r in suffixed.collect()) == ["ACGT", "ACGT-BC1"]


def drawn_cells(d, name, n_ambient=60, n_cells=3):
    """Ambient droplets of a few molecules of all genes, and cells with many of two; their barcodes."""
    rng = random.Random(8)
    letters = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    barcodes = [letters(16) for _ in range(n_ambient + n_cells)]
    (d / f"{name}.white").write_text("\n".join(barcodes) + "\n")
    pairs = []
    for k, b in enumerate(barcodes):
        genes = GENES if k < n_ambient else GENES[:2]
        pairs += [(b + letters(12), rng.choice(genes) + letters(18) + PROBES[k % 2][0]) for _ in range(20 if k < n_ambient else 200)]
    fastq(d / f"{name}_R1.fastq", [x for x, _ in pairs])
    fastq(d / f"{name}_R2.fastq", [y for _, y in pairs])
    return barcodes[n_ambient:], len(pairs)


def test_counts_of_cells_only_and_reads_read_once(spark, files, monkeypatch):
    d, _, _ = files
    cells, n = drawn_cells(d, "cells")
    times = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        times.add(1)
        return x

    seen = seen.asNondeterministic()
    plain = libraries.reads
    monkeypatch.setattr(libraries, "reads", lambda s, paths: plain(s, paths).withColumn("r1_seq", seen("r1_seq")))
    inputs = [str(d / "cells_R1.fastq"), str(d / "cells_R2.fastq")]
    flags = ["-c", str(d / "genes.tsv.gz"), "-w", str(d / "cells.white"), "-p", str(d / "probes.txt"), "--min-ibu-records", "10", "-F", "tsv"]
    cli.main(["workflow", "gex", *inputs, *flags, "-o", str(d / "of_cells")])
    assert times.value == n
    barcodes = lambda folder: {line.split("\t")[0].split("-")[0] for line in text(folder)}
    assert barcodes(d / "of_cells/filtered") == set(cells) and not (d / "of_cells/counts").exists()
    run = json.loads((d / "of_cells/stats/run.json").read_text())
    assert [(x["input_id"], x["reads"], x["mapped_reads"]) for x in run] == [(0, n, n)] and run[0]["elapsed"] > 0
    cli.main(["workflow", "gex", *inputs, *flags, "-o", str(d / "of_all"), "--keep-unfiltered"])
    assert len(barcodes(d / "of_all/counts")) == 63 and barcodes(d / "of_all/filtered") == set(cells)


def test_unprobed_reads_and_mixtures(spark, files):
    d, pairs, crispr = files
    inputs = [str(d / "a_R1.fastq"), str(d / "a_R2.fastq")]
    flags = ["-w", str(d / "white.txt"), "--min-ibu-records", "1"]
    cli.main(["map", "gex", *inputs, *flags, "-c", str(d / "genes.tsv.gz"), "-g", "[barcode][umi:12] | [gex]", "-o", str(d / "unprobed")])
    rows = spark.read.parquet(str(d / "unprobed/ibu")).collect()
    assert {r["alias"] for r in rows} == {"output"} and sum(r["n_reads"] for r in rows) == 300
    inputs = [str(d / "c_R1.fastq"), str(d / "c_R2.fastq")]
    cli.main(["workflow", "crispr", *inputs, *flags, "-p", str(d / "probes.txt"), "-c", str(d / "guides.tsv"), "-o", str(d / "mixed"), "--assignment-mode", "mixture", "--skip-umi"])
    assert {"posterior", "barcode", "index", "count", "alias"} == set(spark.read.parquet(str(d / "mixed/assignments")).columns)


def test_matrices_of_all_aliases_at_once(spark, tmp_path):
    rng = random.Random(13)
    rows = {(a, rng.randrange(4**6), f"G{rng.randrange(30)}"): rng.randint(1, 9) for a in ("BC001", "B=C/2", "output") for _ in range(400)}
    counts = spark.createDataFrame([(*k, n) for k, n in rows.items()], "alias string, barcode long, gene string, count long").repartition(5)
    sinks.write_matrices(counts, str(tmp_path / "all"), bc_len=6)
    assert sorted(p.name for p in (tmp_path / "all").iterdir() if not p.name.startswith(".")) == ["B=C", "BC001", "output"]
    for k, alias in enumerate(("BC001", "B=C/2", "output")):
        sinks.write_matrix(counts.where(F.col("alias") == alias), str(tmp_path / f"one{k}"), bc_len=6, suffix=None if alias == "output" else alias)
        for name in ("matrix.mtx.gz", "barcodes.tsv.gz", "features.tsv.gz"):
            assert text(tmp_path / "all" / alias / name) == text(tmp_path / f"one{k}" / name)
    with pytest.raises(FileExistsError):
        sinks.write_matrices(counts, str(tmp_path / "all"), bc_len=6)
    sinks.write_matrices(counts.where("alias = 'BC001'"), str(tmp_path / "all"), bc_len=6, force=True)
    assert text(tmp_path / "all/BC001/matrix.mtx.gz") == text(tmp_path / "one0/matrix.mtx.gz")


def test_headers_order_and_layouts(spark, files, tmp_path):
    schema = "barcode long, umi long, index long"
    rows = [(1, 2, 0), (1, 3, 0), (2, 0, 1)]
    long, short, wrong = (str(tmp_path / n) for n in ("long", "short", "wrong"))
    ibu.with_header(spark.createDataFrame(rows, schema).coalesce(1), ibu.Header(8, 4, is_sorted=True)).write.parquet(long)
    ibu.with_header(spark.createDataFrame(rows, schema), ibu.Header(7, 4)).write.parquet(short)
    ibu.with_header(spark.createDataFrame(rows[::-1], schema).coalesce(1), ibu.Header(8, 4, is_sorted=True)).write.parquet(wrong)
    with pytest.raises(ValueError, match="headers differ"):
        cli.main(["ibu", "cat", "-i", long, short, "-o", str(tmp_path / "x")])
    with pytest.raises(ValueError, match="lengths"):
        cli.main(["ibu", "view", "-i", long, "--decode", "--bc-len", "16"])
    cli.main(["ibu", "view", "-i", long, "--decode", "-o", str(tmp_path / "v")])
    assert text(tmp_path / "v")[4:6] == ["# sorted: true", "CAAAAAAA\tGAAA\t0"]
    for flags in (["count", "-i", wrong], ["umi", "-i", wrong], ["reads", "-i", wrong, "--require-sorted"]):
        with pytest.raises(ibu.UnsortedError):
            cli.main(["ibu", *flags, "-o", str(tmp_path / "x")])
    cli.main(["ibu", "sort", "-i", wrong, "-o", str(tmp_path / "s")])
    assert ibu.header_of(spark.read.parquet(str(tmp_path / "s"))) == ibu.Header(8, 4, is_sorted=True)
    for name, flags, expected in (
        ("c1", [], ["CAAAAAAA\t2\t0", "GAAAAAAA\t1\t1"]),
        ("c2", ["--index-first"], ["CAAAAAAA\t0\t2", "GAAAAAAA\t1\t1"]),
        ("c3", ["--compressed"], ["1\t0\t2", "2\t1\t1", "barcode\tindex\tcount"]),
    ):
        cli.main(["ibu", "count", "-i", str(tmp_path / "s"), "-o", str(tmp_path / name), *flags])
        assert sorted(set(text(tmp_path / name))) == expected
