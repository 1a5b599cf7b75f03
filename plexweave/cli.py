"""Command line: workflow, map, ibu and download, over the library's functions."""

from __future__ import annotations

import argparse
import itertools
import logging
import shutil
from dataclasses import replace
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexweave.functions import geometry
from plexweave.operators import ibu
from plexweave.operators.mapping import Libraries, flagged, summarised, summary_inputs, summary_records, summary_statistics
from plexweave.plans import workflow
from plexweave.session import kept
from plexweave.sources import download, libraries, sinks


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="plexweave")
    commands = top.add_subparsers(dest="command", required=True)
    for command in ("map", "workflow"):
        kinds = commands.add_parser(command).add_subparsers(dest="kind", required=True)
        for kind in ("gex", "crispr"):
            p = kinds.add_parser(kind)
            p.add_argument("inputs", nargs="+")
            p.add_argument("-c", "--gex" if kind == "gex" else "--guides", dest="library", required=True)
            p.add_argument("-g", "--geometry")
            p.add_argument("--preset", choices=geometry.PRESETS)
            p.add_argument("--remap-window", type=int)
            p.add_argument("-x", "--exact", action="store_true")
            p.add_argument("--no-umi-qual-check", action="store_true")
            p.add_argument("-p", "--probes")
            p.add_argument("--probe-regex")
            p.add_argument("-w", "--whitelist", required=True)
            p.add_argument("-o", "--outdir", default="./plexweave_out")
            p.add_argument("-f", "--force", action="store_true")
            p.add_argument("--min-ibu-records", type=int, default=1000)
            if command == "workflow":
                for flag in ("--skip-umi", "--skip-reads", "--no-filter", "--keep-unfiltered", "--keep-ibu", "--skip-assignment"):
                    p.add_argument(flag, action="store_true")
                p.add_argument("-F", "--format", choices=("mtx", "tsv"), default="mtx")
                if kind == "crispr":
                    p.add_argument("--assignment-mode", choices=("tests", "mixture"), default="tests")
                    p.add_argument("--min-umi-cells", type=int, help="5, or 3 for mixtures")
                    p.add_argument("--min-umi-guides", type=int, default=5)
                    p.add_argument("--log-odds-ratio", type=float)
                    p.add_argument("--fdr-threshold", type=float, default=0.05)
    kinds = commands.add_parser("ibu").add_subparsers(dest="kind", required=True)
    for kind in ("view", "cat", "sort", "count", "umi", "reads"):
        p = kinds.add_parser(kind)
        p.add_argument("-i", "--input", nargs="+", required=True)
        p.add_argument("-o", "--output", required=kind != "view", help="a folder; a view without one goes to standard output")
        p.add_argument("-f", "--features")
        p.add_argument("-C", "--feature-col", type=int, default=1 if kind == "count" else 0)
        p.add_argument("--bc-len", type=int, help="of tables without a header, 16 if not given; another length than a header's is an error")
        p.add_argument("--umi-len", type=int, help="as --bc-len, 12 if not given")
        p.add_argument("-w", "--whitelist")
        p.add_argument("-s", "--suffix")
        p.add_argument("-l", "--log")
        p.add_argument("-t", "--ties", choices=("reference", "strict"), default="reference")
        for flag in ("--mtx", "--decode", "--encoded", "--compressed", "--no-header", "--header-only", "--skip-header", "--index-first", "--require-sorted"):
            p.add_argument(flag, action="store_true")
    p = commands.add_parser("download")
    p.add_argument("-o", "--outdir", required=True)
    p.add_argument("-v", "--version", required=True)
    p.add_argument("-f", "--force", action="store_true")
    p.add_argument("--url", required=True)
    return top


def _inputs(spark: SparkSession, a: argparse.Namespace) -> tuple:
    shape, window = geometry.select(a.kind, a.preset, a.geometry, a.remap_window)
    probes = libraries.probe_barcodes(spark, a.probes, a.probe_regex) if a.probes else None
    known = libraries.whitelist(spark, a.whitelist)
    if a.kind == "gex":
        library = libraries.gex_library(spark, a.library)
        features = library.select(F.col("idx").alias("index"), F.col("probe_name").alias("unit"), F.col("gene_name").alias("gene"))
        libs = Libraries(known, gex=library.select("idx", "seq"), probes=probes)
    else:
        library = libraries.guide_library(spark, a.library)
        features = library.select(F.col("idx").alias("index"), F.col("name").alias("unit"), F.col("name").alias("gene"))
        libs = Libraries(known, guides=library.select("idx", "anchor", "protospacer"), probes=probes)
    return libraries.reads(spark, a.inputs), shape, window, libs, features


def _map(spark: SparkSession, a: argparse.Namespace) -> None:
    folder = workflow.claim_folder(a.outdir, a.force)
    log, timings = workflow.dual_log(str(folder / "plexweave.log")), workflow.Timings()
    reads, shape, window, libs, features = _inputs(spark, a)
    head = ibu.Header(libs.sizes()["barcode"][1], shape.resolve({})["umi"].length)
    sinks.write_tsv(features.orderBy("index").select("unit", "gene"), str(folder / "metadata/features.tsv"))

    def save(name: str, rows: DataFrame) -> DataFrame:
        with timings.stage(workflow.STAGES[name]):
            if name in ("mapped", "clusters"):
                return kept(rows)
            rows = ibu.with_header(rows, head) if name in ("ibu", "corrected") else rows
            sinks.write_records(rows, str(folder / name))
        return spark.read.schema(rows.schema).parquet(str(folder / name))

    if a.command == "map":
        mapped = save("mapped", summarised(flagged(reads, shape, libs, window, a.exact, not a.no_umi_qual_check)))
        save("ibu", ibu.keep_large(summary_records(mapped), at_least=a.min_ibu_records))
        _write_statistics(mapped, timings, shape, window, libs, a, folder, log)
        timings.write(folder)
        return
    crispr = a.kind == "crispr"
    options = {}
    if crispr:
        mixture = a.assignment_mode == "mixture"
        least = a.min_umi_cells if a.min_umi_cells is not None else 3 if mixture else 5
        options = {"mixture": mixture, "min_umi_cells": least, "min_umi_guides": a.min_umi_guides, "min_log_odds": a.log_odds_ratio}
        options |= {} if mixture else {"fdr": a.fdr_threshold}
    skip_last = a.skip_assignment if crispr else a.no_filter
    done = workflow.run(reads, shape, libs, features, window, a.exact, a.min_ibu_records, a.skip_umi, True, not skip_last, not a.no_umi_qual_check, save=save, **options)
    found = _write_statistics(done.mapped, timings, shape, window, libs, a, folder, log)
    if done.records.isEmpty():
        raise ibu.EmptyStreamError(f"no alias has records enough; {found['mapped_reads']} reads are mapped")
    if not a.skip_umi:
        sinks.write_json(ibu.umi_stats(done.clusters), str(folder / "stats/umi.json"))
    if not a.skip_reads:
        with timings.stage(workflow.STAGES["reads"]):
            sinks.write_tsv(ibu.reads_per_barcode(done.corrected, by=workflow.ALIAS), str(folder / "reads"), header=True)
    with timings.stage(workflow.STAGES["units"]):
        aliases = {r["alias"] for r in done.records.select("alias").distinct().collect()}  # as many as there are probes
        whole = aliases
        if not crispr and not a.no_filter:
            celled = {r["alias"] for r in done.final.where("is_cell").select("alias").distinct().collect()}
            for alias in sorted(aliases - celled):
                log.warning("no cells in %s: its counts are kept unfiltered", alias)
            _write_counts(done.filtered(), celled, folder / "filtered", a.format, head.bc_len)
            whole = aliases if a.keep_unfiltered else aliases - celled
        _write_counts(done.counts, whole, folder / "counts", a.format, head.bc_len)
    if not a.keep_ibu:
        for name in ("ibu", "corrected", "units"):
            shutil.rmtree(folder / name, ignore_errors=True)
    timings.write(folder)


def _write_counts(counts: DataFrame, aliases: set[str], folder: Path, form: str, bc_len: int) -> None:
    """Tables of all of `aliases`, or a matrix for each; nothing where there are none."""
    if not aliases:
        return
    own = counts.where(F.col("alias").isin(sorted(aliases)))
    if form == "tsv":
        sinks.write_tsv(workflow.suffixed(ibu_decoded(own, bc_len)).select("barcode", "gene", "count"), str(folder))
    else:
        sinks.write_matrices(own, str(folder), bc_len=bc_len)


def _write_statistics(mapped: DataFrame, timings: workflow.Timings, shape: geometry.Geometry, window: int, libs: Libraries, a: argparse.Namespace, folder: Path, log: logging.Logger) -> dict:
    """stats/mapping.json, library.json and run.json: reasons of reads, what was searched and where, and reads by input with
    the seconds of the mapping, which all inputs share. Nothing here reads the reads again."""
    found = sinks.write_json(summary_statistics(mapped), str(folder / "stats/mapping.json"))
    sinks.write_json_rows(libs.statistics(shape, window, a.exact), str(folder / "stats/library.json"))
    seconds = sum(s for _, stage, s in timings.rows if stage == workflow.STAGES["mapped"])
    by_input = {r["input_id"]: r for r in summary_inputs(mapped).collect()}  # a row for each pair of files
    n = len(a.inputs) if all(p.rstrip("/").endswith(".parquet") for p in a.inputs) else len(a.inputs) // 2
    rows = [{"input_id": k, "reads": by_input[k]["reads"] if k in by_input else 0, "mapped_reads": by_input[k]["mapped_reads"] if k in by_input else 0, "elapsed": seconds} for k in range(n)]
    sinks.write_json_rows(rows, str(folder / "stats/run.json"))
    log.info("mapped %s of %s reads in %.1f s", found["mapped_reads"], found["total_reads"], seconds)
    return found


def _ibu(spark: SparkSession, a: argparse.Namespace) -> None:
    parts = [libraries.records(spark, [p]) for p in a.input]
    head = ibu.common_header(parts, a.bc_len, a.umi_len)
    for part in parts:  # a table that says so is held to it
        if a.require_sorted or (ibu.header_of(part) or head).is_sorted and a.kind in ("umi", "count"):
            ibu.require_sorted(part)
    rows = libraries.records(spark, a.input)
    features = libraries.features(spark, a.features, a.feature_col) if a.features else None
    if a.kind == "view":
        out = ibu.view(rows, a.decode, head.bc_len, head.umi_len, features, "feature")
        lines = out.select(F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in out.columns)).alias("value"))
        top, lines = [] if a.skip_header else head.lines(), None if a.header_only else lines
        if a.output:
            sinks.write_with_header(top, lines, spark, a.output)
        else:  # line by line, a partition at a time
            for line in itertools.chain(top, (r["value"] for r in lines.toLocalIterator()) if lines is not None else ()):
                print(line)
    elif a.kind == "cat":
        ibu.with_header(rows, head).write.parquet(a.output)
    elif a.kind == "sort":
        ibu.with_header(ibu.sort(rows), replace(head, is_sorted=True)).write.parquet(a.output)
    elif a.kind == "umi":
        clusters = kept(ibu.umi_clusters(kept(ibu.weigh(rows))))
        ibu.with_header(ibu.with_corrected(clusters), replace(head, is_sorted=False)).write.parquet(a.output)
        if a.log:
            sinks.write_json(ibu.umi_stats(clusters), a.log)
    elif a.kind == "reads":
        known = libraries.strict_whitelist(spark, a.whitelist) if a.whitelist else None
        out = ibu.reads_per_barcode(ibu.weigh(rows), known)
        out = out if a.encoded else ibu_decoded(out, head.bc_len)
        sinks.write_tsv(out, a.output, header=not a.no_header)
    else:
        counts = ibu.count(ibu.weigh(rows), ties=a.ties, n_features=features.count() if features is not None else None, allow_empty=False)
        if features is not None:
            counts = ibu.by_aggregate(counts, features, "feature")
        if a.mtx:
            if features is None:
                raise ValueError("a matrix needs features")
            sinks.write_matrix(counts, a.output, "feature", head.bc_len, a.suffix)
        else:
            # without features, decoded counts come before the index unless asked otherwise, and packed ones have column names
            table = sinks.count_table(counts, head.bc_len, a.compressed, column="feature", suffix=a.suffix, swapped=not a.index_first)
            sinks.write_tsv(table, a.output, header=a.compressed and features is None and not a.no_header)


def ibu_decoded(rows: DataFrame, length: int) -> DataFrame:
    from plexweave.functions.sequence import decode

    return rows.withColumn("barcode", decode(F.col("barcode"), length))


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "download":
        download.fetch(a.url, str(Path(a.outdir).expanduser()), a.version, a.force)
        return
    spark = SparkSession.builder.appName("plexweave").getOrCreate()
    (_ibu if a.command == "ibu" else _map)(spark, a)


if __name__ == "__main__":
    main()
