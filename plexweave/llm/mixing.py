"""Mixing sources to target weights along a time-varying curriculum, in DataFrame operations only.

Each source has a weight schedule over training time 0..1, piecewise linear between knots. Its integral is the
source's cumulative token demand; inverting that gives the time at which a given token of the source is due.
Documents are laid end to end within their source, so a document's token offset gives its training position,
and a range sort by position gives the training order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexweave.llm.common import checkpointed, n_words

#: No document is taken more often than this.
MAX_REPEATS = 3
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
#: Weight schedules over time, as (time, weight) knots, by the source's rank, repeating: one that falls, one level, one that rises.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
#: How often a source's documents are gone through for its rest, each time past those larger than what is still missing.
PASSES = 4
#: Hexadecimal digits of a document's hash that name its bucket in the two-level running sums.
BUCKET_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, rank, target: `sizes` (source, source_size) with each source's share of all words.

    Shares are by weight; a target stops at `repeats` times its source's size and the excess is shared again by
    weight until none is above. With sources in the order of capacity per weight, the full ones are a prefix: the
    level is the remaining words per remaining weight at the first source that is not full.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    all_rows = Window.partitionBy()
    before = Window.orderBy("ratio", F.col("rank")).rowsBetween(Window.unboundedPreceding, -1)
    ranked = sizes.withColumn("rank", F.row_number().over(by_name) - 1).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    )
    levels = (
        ranked.withColumn("cap", repeats * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("words_left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("words_left") / F.col("weight_left"))
    )
    level = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(all_rows)
    return levels.withColumn("at", level["level"]).select(
        "source",
        "source_size",
        "rank",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("at") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def _segments(schedules) -> Column:
    """For each rank, the schedule's segments as (t0, w0, t1, w1, demand before, all demand): integrals by trapezoids."""
    out = []
    for knots in schedules:
        done, rows = 0.0, []
        total = sum((t1 - t0) * (w0 + w1) / 2 for (t0, w0), (t1, w1) in zip(knots, knots[1:]))
        for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
            part = (t1 - t0) * (w0 + w1) / 2
            rows.append(F.struct(*(F.lit(float(v)).alias(k) for k, v in zip(("t0", "w0", "t1", "w1", "d0", "d1"), (t0, w0, t1, w1, done / total, (done + part) / total)))))
            done += part
        out.append(F.array(*rows))
    return F.array(*out)


def due_time(share: Column, rank: Column, schedules=SCHEDULES) -> Column:
    """The time at which a source's cumulative demand reaches `share` (0 to 1) of its whole: the integral inverted."""
    segments = F.element_at(_segments(schedules), (rank % len(schedules) + 1).cast("int"))
    x = F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))
    s = F.element_at(F.filter(segments, lambda seg: seg["d1"] >= x), 1)
    total = F.element_at(F.array(*(F.lit(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(k, k[1:]))) for k in schedules)), (rank % len(schedules) + 1).cast("int"))
    area = (x - s["d0"]) * total
    slope = (s["w1"] - s["w0"]) / (s["t1"] - s["t0"])
    # area = w0 dt + slope dt^2 / 2, solved for dt in the form that also holds for slope 0
    return s["t0"] + 2 * area / (s["w0"] + F.sqrt(F.greatest(F.lit(0.0), s["w0"] * s["w0"] + 2 * slope * area)))


def _taken(passes: int) -> Column:
    """Whether one of the first passes took a row: it was no larger than what was missing, and lies up to the pass's last row."""
    out = F.lit(False)
    for p in range(passes):
        upto = (F.col("bucket") < F.col(f"bucket{p}")) | ((F.col("bucket") == F.col(f"bucket{p}")) & (F.col("seq") <= F.col(f"seq{p}")))
        out = out | ((F.col("size") > 0) & (F.col("size") <= F.col(f"gap{p}")) & upto)
    return out


def _of_sources(rows: DataFrame, sources: DataFrame) -> DataFrame:
    return rows.join(sources.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")


def _pass(rows: DataFrame, sources: DataFrame, p: int) -> DataFrame:
    """`sources` with the last row (bucket, seq) that pass `p` takes of each, and the words still missing after it.

    A pass goes by the hash through rows that are not taken and no larger than what is missing, up to the first that
    does not fit. Sums of buckets tell in which bucket that is; only its rows are numbered.
    """
    gap = f"gap{p}"
    open_ = _of_sources(rows, sources).where((F.col("size") > 0) & (F.col("size") <= F.col(gap)) & ~_taken(p))
    sums = open_.groupBy("source", "bucket", gap).agg(F.sum("size").alias("n"))
    run = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    crossing = F.when(F.col("run") > F.col(gap), F.struct("bucket", (F.col("run") - F.col("n")).alias("before")))
    at = sums.withColumn("run", run).groupBy("source").agg(F.min(crossing).alias("at"), F.max("run").alias("all"))
    at = at.select(F.col("source").alias("s3"), F.col("at.bucket").alias("b3"), F.col("at.before").alias("before"), "all")
    inside = F.sum("size").over(Window.partitionBy("source").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    last = (
        open_.join(at.where("b3 is not null"), F.col("source").eqNullSafe(F.col("s3")) & (F.col("bucket") == F.col("b3")))
        .withColumn("run", inside + F.col("before"))
        .where(F.col("run") <= F.col(gap))
        .groupBy("source")
        .agg(F.max("seq").alias("last"), F.max("run").alias("run"))
        .withColumnRenamed("source", "s4")
    )
    return (
        sources.join(at, F.col("source").eqNullSafe(F.col("s3")), "left")
        .join(last, F.col("source").eqNullSafe(F.col("s4")), "left")
        .withColumns({
            f"bucket{p}": F.coalesce("b3", F.lit("~")),  # after all buckets
            f"seq{p}": F.coalesce("last", F.lit(0)),
            f"gap{p + 1}": F.col(gap) - F.coalesce("run", "before", "all", F.lit(0)),
        })
        .drop("s3", "b3", "before", "all", "s4", "last", "run")
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, schedules=SCHEDULES, repeats: int = MAX_REPEATS, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, position (and middle, last, extra, rank, source, print, a hash of the text): how the mix takes each row of `docs`.

    A source with target t and size s takes every document floor(t / s) times. The rest is filled by documents in the
    order of a hash of their ids, up to the first that does not fit; then again by those no larger than what is missing,
    PASSES times in all, so a long document holds up none of the shorter ones behind it; one more document, the one
    nearest in size to what is still missing, is added where that brings the source nearer to its target. `position` (0
    to 1, null where nothing is taken) is the time at which the middle of the document's first copy is due; `middle` is
    its offset, and `last` that of a copy for the rest (`extra`), whose documents follow on each other.
    Null and empty texts have size 0 and are never taken; a null source is a source of its own, last in order; null
    ids come in the order of the empty string; rows that repeat an id count one by one. An empty table gives an
    empty result. Only the three columns named are read.

    A source's running sums go over buckets of the hash first and then within a bucket, so no task holds a source.
    """
    key = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), key.alias("key"), F.xxhash64(text_col).alias("print")
    ).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    by_key = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "print")
    upto = by_key.rowsBetween(Window.unboundedPreceding, 0)
    # words are counted once, and texts read once
    rows = checkpointed(sized.withColumn("seq", F.row_number().over(by_key)).withColumn("end", F.sum("size").over(upto)).drop("key"))
    sources = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = checkpointed(sources.withColumn("epochs", epochs).withColumn("gap0", F.col("target") - F.col("epochs") * F.col("source_size")))
    for p in range(PASSES):
        sources = checkpointed(_pass(rows, sources, p))
    missing = F.col(f"gap{PASSES}")
    pick = (
        _of_sources(rows, sources)
        .where((F.col("size") > 0) & (F.col("epochs") < repeats) & ~_taken(PASSES))
        .withColumn("off", F.abs(F.col("size") - missing))
        .where(F.col("off") < missing)
        .groupBy("source")
        .agg(F.min(F.struct("off", "bucket", "seq")).alias("pick"))
        .withColumnRenamed("source", "s5")
    )
    sources = checkpointed(sources.join(pick, F.col("source").eqNullSafe(F.col("s5")), "left").drop("s5"))
    picked = F.coalesce((F.col("bucket") == F.col("pick.bucket")) & (F.col("seq") == F.col("pick.seq")), F.lit(False))
    laid = _of_sources(rows, sources).withColumn("extra", _taken(PASSES) | picked).withColumn("extra_size", F.when(F.col("extra"), F.col("size")).otherwise(0))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = laid.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.sum("extra_size").alias("m"))
    starts = starts.select(F.col("source").alias("s6"), F.col("bucket").alias("b6"), *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_start") for c in ("n", "m")))
    in_bucket = Window.partitionBy("source", "bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    half = F.col("size") / 2
    return (
        laid.withColumn("extra_end", F.sum("extra_size").over(in_bucket))
        .join(starts, F.col("source").eqNullSafe(F.col("s6")) & (F.col("bucket") == F.col("b6")))
        .withColumn("extra_middle", F.col("extra_end") + F.col("m_start") - half)
        .withColumn("middle", F.when(F.col("epochs") > 0, F.col("end") + F.col("n_start") - half).otherwise(F.col("extra_middle")))
        .withColumn("copies", F.when(F.col("size") > 0, F.col("epochs") + F.col("extra").cast("long")).otherwise(0))
        .select(
            "doc_id",
            "size",
            "source_size",
            "target",
            (F.col("size") * F.col("copies")).alias("taken"),
            "copies",
            F.when(F.col("copies") > 0, due_time(F.col("middle") / F.col("target"), F.col("rank"), schedules)).alias("position"),
            "middle",
            (F.col("epochs") * F.col("source_size") + F.col("extra_middle")).alias("last"),
            "extra",
            "rank",
            "source",
            "print",
        )
    )


def training_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """`docs`, each row as often as the mix takes it, range-sorted by the position of each copy; columns as they were.

    Copies of a document lie one source length apart, but for the one of the rest. Rows are told by id, text and source; rows that are alike in these
    are numbered, so that each is taken as often as one of them is.
    """
    mark = next(f"mix{'_' * k}" for k in range(1, len(docs.columns) + 2) if not any(c.lower().startswith(f"mix{'_' * k}") for c in docs.columns))
    id_, print_, source, at, number = (f"{mark}{c}" for c in ("id", "print", "source", "at", "number"))
    keys = [id_, print_, source]
    plan = mixed(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).withColumnsRenamed({"doc_id": id_, "print": print_, "source": source})
    offset = lambda k: F.when(F.col("extra") & (k == F.col("copies") - 1), F.col("last")).otherwise(F.col("middle") + k * F.col("source_size"))
    due = lambda k: due_time(offset(k) / F.col("target"), F.col("rank"), options.get("schedules", SCHEDULES))
    times = F.transform(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")), due)
    # all rows of a key, with the times of each that is taken
    timed = plan.groupBy(*keys).agg(F.count("*").alias("rows"), F.array_sort(F.collect_list(F.when(F.col("copies") > 0, times))).alias("times")).where(F.size("times") > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select("*", F.col(f"`{id_col}`").alias(id_), F.xxhash64(F.col(f"`{text_col}`")).alias(print_), F.col(f"`{source_col}`").alias(source))

    def joined(left: DataFrame, right: DataFrame, more: list[str]) -> DataFrame:
        right = right.withColumnsRenamed({k: f"{k}2" for k in [*keys, *more]})
        same = F.lit(True)
        for k in [*keys, *more]:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
        return left.join(right, same).select(*columns, id_, at)

    once = joined(rows, timed.where("rows = 1").select(*keys, F.explode(F.element_at("times", 1)).alias(at)), [])
    again = timed.where("rows > 1").select(*keys, F.posexplode("times").alias(number, "each")).select(*keys, number, F.explode("each").alias(at))
    few = timed.where("rows > 1").select(*keys).withColumnsRenamed({k: f"{k}2" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
    alike = rows.join(few, same, "left_semi").withColumn(number, F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))) - 1)
    return once.unionByName(joined(alike, again, [number])).orderBy(at, id_).select(*columns)
