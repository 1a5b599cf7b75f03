"""Joins of read segments to reference sequences with at most one mismatch.

All plans give the same result: for a segment, the index of the reference sequence equal to it (the smallest of several),
else the only one at distance one, else nothing. They differ in what is expanded:

* variants: every reference with all its one-base changes is one broadcast table, for small references of checked size;
* parts: equal sequences are one broadcast table; for what they leave, a mismatch leaves one half intact, so both halves
  of the references are broadcast, each with the sequences that have it, up to a checked number of references;
* halves: the same as shuffled equi-joins, for references of any size: reads meet equal sequences first, and of the others
  the distinct segments meet the references by whichever half (of short sequences: two thirds) is intact;
* misses: as halves, but distinct segments are expanded.

The first two only add broadcast joins to the plan of the reads, up to three for each shift, so any chain of lookups
reads its input once and moves no read. The last two move each read once, and those without an equal sequence at the
first shift once more; what a read carries along had better be little.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexweave.functions.sequence import hamming, piece, variants

#: Variant tables of up to so many rows are broadcast, and references of up to so many sequences in two halves.
BROADCAST_ROWS, BROADCAST_SEQUENCES = 250_000, 2_000_000
#: Rows of a reference that a task of a shuffled join holds; with more of them both sides are sorted.
HELD_ROWS = 500_000
LETTERS = "ACGTN"


def exact_keys(reference: DataFrame) -> DataFrame:
    """key, idx: each distinct sequence of `reference` (idx, seq) with its smallest index."""
    return reference.where("seq is not null").groupBy(F.col("seq").alias("key")).agg(F.min("idx").alias("idx"))


def variant_keys(reference: DataFrame, length: int) -> DataFrame:
    """key, idx: all strings within one change of a reference, without those of two references unless equal to one."""
    parents = exact_keys(reference)
    rows = parents.select("idx", F.col("key").alias("parent"), F.explode(variants(F.col("key"), length, LETTERS)).alias("key"))
    return (
        rows.groupBy("key")
        .agg(F.min(F.when(F.col("key") == F.col("parent"), F.col("idx"))).alias("own"), F.count("*").alias("n"), F.min("idx").alias("only"))
        .where("own is not null or n = 1")
        .select("key", F.coalesce("own", "only").alias("idx"))
    )


def _resolved(found: DataFrame) -> DataFrame:
    """seg, idx from candidates (seg, idx, d)."""
    return (
        found.distinct()
        .groupBy("seg")
        .agg(F.min(F.when(F.col("d") == 0, F.col("idx"))).alias("own"), F.count("*").alias("n"), F.min("idx").alias("only"))
        .where("own is not null or n = 1")
        .select("seg", F.coalesce("own", "only").alias("idx"))
    )


def _once(rows: DataFrame) -> DataFrame:
    """`rows` as those of a generator: no filter or choice of columns goes below it, so one shuffle serves all that follows."""
    return rows.select(F.inline(F.array(F.struct("*"))))


def _held(reference: DataFrame, n: int | None) -> DataFrame:
    """`reference` of `n` rows as the side of a shuffled join that tasks hold, so that the other one is not sorted."""
    parts = int(reference.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return reference.hint("shuffle_hash") if n is not None and n <= HELD_ROWS * parts else reference


def match_by_halves(segments: DataFrame, reference: DataFrame, length: int, n: int | None = None) -> DataFrame:
    """seg, idx: distinct `segments` (seg) matched through whichever half is intact, as two equi-joins.

    Where more of the `n` references than one would share a half by chance, sequences are cut in three, of which two are
    intact, and there are three joins.
    """
    cuts = 2 if n is None or n <= 4 ** (length // 2) else 3
    ends = [length * k // cuts for k in range(cuts + 1)]
    parents = exact_keys(reference)
    sides = []
    for start, end in zip(ends, ends[1:]):
        rest = lambda c: F.concat(F.substring(c, 1, start), F.substring(c, end + 1, length - end))  # noqa: B023, E731
        own = lambda c: F.substring(c, start + 1, end - start)  # noqa: B023, E731
        both = segments.withColumn("h", rest("seg")).join(_held(parents.withColumn("h", rest("key")), n), "h")
        # strings of one length are one edit apart iff one letter differs
        sides.append(both.select("seg", "idx", F.levenshtein(own("seg"), own("key"), 1).alias("d")).where("d >= 0"))
    return _resolved(reduce(DataFrame.union, sides))


def match_by_misses(segments: DataFrame, reference: DataFrame, length: int) -> DataFrame:
    """seg, idx: exact partners first; the other segments are expanded into their variants."""
    parents = exact_keys(reference)
    exact = segments.join(parents.withColumnRenamed("key", "seg"), "seg")
    rest = segments.join(parents.select(F.col("key").alias("seg")), "seg", "left_anti")
    # a segment with a letter beyond ACGT can only be repaired there
    near = rest.select("seg", F.explode(variants(F.col("seg"), length)).alias("key")).join(parents, "key").select("seg", "idx", F.lit(1).alias("d"))
    return exact.select("seg", "idx").union(_resolved(near))


def plan_for(n: int, length: int, exact: bool = False) -> str:
    """The plan for a reference of `n` sequences of one length."""
    if not exact and n * (1 + 4 * length) <= BROADCAST_ROWS:
        return "variants"
    return "parts" if n <= BROADCAST_SEQUENCES else "halves"


def match(segments: DataFrame, reference: DataFrame, length: int, exact: bool = False, plan: str = "halves", n: int | None = None) -> DataFrame:
    """seg, idx of distinct `segments` (seg); `exact` allows no mismatch. `plan`: halves or misses."""
    if exact:
        return segments.join(exact_keys(reference).withColumnRenamed("key", "seg"), "seg").select("seg", "idx")
    return match_by_halves(segments, reference, length, n) if plan == "halves" else match_by_misses(segments, reference, length)


class Index:
    """A reference of checked size, broadcast; `hits` adds its matches to rows.

    Equal sequences come first, as a table of their own, unless `first` says that no row has one.
    """

    def __init__(self, reference: DataFrame, length: int, exact: bool, plan: str, first: bool = True):
        self.length, self.exact, self.half = length, exact, length // 2
        self.parts = plan == "parts" and not exact
        parents = exact_keys(reference)
        self.first = first and self.parts
        if self.first or not self.parts:
            keys = parents if exact or self.parts else variant_keys(reference, length)
            self.keys = F.broadcast(keys.select(F.col("key").alias("__key"), F.col("idx").alias("__hit")))
        if not self.parts:
            return
        own = lambda start, size, rest, rest_size, key, out: F.broadcast(
            parents.groupBy(F.substring("key", start, size).alias(key)).agg(F.collect_list(F.struct(F.substring("key", rest, rest_size).alias("rest"), "idx")).alias(out))
        )
        h = self.half
        self.left = own(1, h, h + 1, length - h, "__lkey", "__ls")
        self.right = own(h + 1, length - h, 1, h, "__rkey", "__rs")

    def hits(self, rows: DataFrame) -> DataFrame:
        """`rows` with __hit, the match of the column __seg."""
        if not self.parts:
            return rows.join(self.keys, F.col("__seg") == F.col("__key"), "left").drop("__key")
        h, segment = self.half, F.col("__seg")
        if self.first:
            rows = rows.join(self.keys.withColumnRenamed("__hit", "__own"), segment == F.col("__key"), "left")
            segment = F.when(F.col("__key").isNull(), segment)
        left, right = F.substring(segment, 1, h), F.substring(segment, h + 1, self.length - h)
        both = rows.join(self.left, left == F.col("__lkey"), "left").join(self.right, right == F.col("__rkey"), "left")
        # strings of one length are one edit apart iff one letter differs
        near = lambda c, rest: F.filter(c, lambda x: F.levenshtein(x["rest"], rest, 1) == 1)
        apart = F.concat(F.coalesce(near("__ls", right), F.array()), F.coalesce(near("__rs", left), F.array()))
        only = F.when(F.size(apart) == 1, F.get(apart, F.lit(0))["idx"])
        same = F.array_min(F.transform(F.filter("__ls", lambda x: x["rest"] == right), lambda x: x["idx"]))
        found = F.when(F.col("__ls").isNotNull() | F.col("__rs").isNotNull(), only if self.first else F.coalesce(same, only))
        return both.withColumn("__hit", F.coalesce("__own", found) if self.first else found).drop("__lkey", "__rkey", "__ls", "__rs", "__key", "__own")


def offsets(window: int) -> list[int]:
    """Shifts in the order in which they are tried: 0, then one further on either side, to the right first."""
    return [0, *(s for d in range(1, window + 1) for s in (d, -d))]


def _searched(rows: DataFrame, name: str, start: Column, shifts: list[int], sequence: Column, length: int, hits) -> DataFrame:
    """`rows` with `name` and `name`_shift from the first shift at which `hits` adds a __hit to the segment __seg.

    Rows that have their match have no segment at later shifts, so these cost them nothing. The first hit is picked by
    a function over an array, which also ends the stage of generated code: one for all lookups would be too long.
    """
    found = [f"__hit{k}" for k in range(len(shifts))]
    for k, s in enumerate(shifts):
        segment = piece(sequence, start + s, length)
        rows = hits(rows.withColumn("__seg", F.when(F.coalesce(*found[:k]).isNull(), segment) if k else segment))
        rows = rows.withColumnRenamed("__hit", found[k]).drop("__seg")
    options = F.array(*(F.struct(F.lit(s).alias("shift"), F.col(c).alias("hit")) for s, c in zip(shifts, found)))
    rows = rows.withColumn("__first", F.get(F.filter(options, lambda x: x["hit"].isNotNull()), F.lit(0))).drop(*found)
    return rows.withColumns({name: F.col("__first.hit"), f"{name}_shift": F.col("__first.shift")}).drop("__first")


def lookup(reads: DataFrame, name: str, sequence: Column, start: Column | int, reference: DataFrame, length: int, window: int = 0, exact: bool = False, plan: str = "auto", n: int | None = None) -> DataFrame:
    """`reads` with columns `name` (index or null) and `name`_shift: the match at the first shift that has one.

    `n` is the number of sequences of the reference, counted where it is not given.
    """
    at = F.lit(start) if isinstance(start, int) else start
    shifts = offsets(window)
    if plan == "auto":
        plan = plan_for(reference.count() if n is None else n, length, exact)
    if plan in ("variants", "parts"):
        return _searched(reads, name, at, shifts, sequence, length, Index(reference, length, exact, plan).hits)
    return _by_segments(reads, name, at, shifts, sequence, length, exact_keys(reference), lambda segments: match(segments, reference, length, exact, plan, n), n)


def _by_segments(reads: DataFrame, name: str, start: Column, shifts: list[int], sequence: Column, length: int, equal: DataFrame, matcher, n: int | None) -> DataFrame:
    """`reads` with `name` and `name`_shift, for references too large to broadcast.

    Reads take along the stretch that holds their segments of all shifts, and meet `equal` (key, idx), the `n` sequences that
    match as they are, with that of the first shift. Of the other reads the distinct stretches are matched (`matcher` makes
    seg, idx of distinct seg), and meet their reads in one more join.
    """
    ahead = -min(shifts)
    lead = F.least(start, F.lit(ahead))
    # too short a stretch has no segment; by this number such reads go to all tasks
    stretch = sequence.substr((start - lead).cast("int") + 1, (lead + length + max(shifts)).cast("int"))
    segment = lambda s: piece(F.col("__stretch"), F.col("__lead") + s, length)
    rows = reads.withColumns({"__stretch": F.when(start >= 0, stretch), "__lead": lead.cast("int")})
    rows = rows.withColumn("__apart", F.when(segment(shifts[0]).isNull(), F.xxhash64(*reads.columns).cast("string")))
    key = F.coalesce(segment(shifts[0]), F.col("__apart"))
    met = rows.join(_held(equal.select(F.col("key").alias("__key"), F.col("idx").alias("__own")), n), key == F.col("__key"), "left").drop("__key", "__apart")
    met = _once(met)
    out = lambda rows, idx, shift: rows.select(*reads.columns, idx.alias(name), shift.cast("int").alias(f"{name}_shift"))
    done = out(met.where("__own is not null"), F.col("__own"), F.lit(shifts[0]))
    rest = met.where(F.col("__own").isNull())
    whole = F.coalesce(F.length("__stretch") >= length, F.lit(False))
    kind = equal.schema["idx"].dataType
    none = out(rest.where(~whole), F.lit(None).cast(kind), F.lit(None))
    rest = rest.where(whole).drop("__own")
    options = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("shift"), segment(s).alias("seg")) for k, s in enumerate(shifts)))
    segments = rest.select("__stretch", "__lead").distinct().select("__stretch", "__lead", F.inline(options)).where("seg is not null")
    matched = matcher(_once(segments.select("seg").distinct()))
    first = segments.join(matched, "seg").groupBy("__stretch", "__lead").agg(F.min(F.struct("k", "shift", "idx")).alias("__first"))
    near = out(rest.join(first, ["__stretch", "__lead"], "left"), F.col("__first.idx"), F.col("__first.shift"))
    return done.unionByName(near).unionByName(none)


def _agreed(library: DataFrame, length: int) -> DataFrame:
    """key, idx: sequences of `library` (idx, seq) as wholes, where both halves lead to the same index."""
    half = length // 2
    least = lambda cut: F.min("idx").over(Window.partitionBy(cut))
    found = library.withColumns({"l_idx": least(F.substring("seq", 1, half)), "r_idx": least(F.substring("seq", half + 1, length - half))})
    return found.where("l_idx = r_idx").groupBy(F.col("seq").alias("key")).agg(F.min("l_idx").alias("idx"))


def _match_split(segments: DataFrame, library: DataFrame, length: int, budget: int, n: int | None = None) -> DataFrame:
    """seg, idx: distinct `segments` (seg) judged by both halves, as shuffled joins of distinct halves with those of the library."""
    half = length // 2
    found = segments.withColumns({"l": F.substring("seg", 1, half), "r": F.substring("seg", half + 1, length - half)})
    for side, start, size in (("l", 1, half), ("r", half + 1, length - half)):
        own = match_by_halves(_once(found.select(F.col(side).alias("seg")).distinct()), library.select("idx", F.substring("seq", start, size).alias("seq")), size, n)
        found = found.join(own.select(F.col("seg").alias(side), F.col("idx").alias(f"{side}_idx")), side, "left")
    whole = library.groupBy(F.col("idx").alias("single")).agg(F.min("seq").alias("ref"))
    one = F.when(F.col("l_idx").isNull() | F.col("r_idx").isNull(), F.coalesce("l_idx", "r_idx"))
    found = found.where("l_idx is not null or r_idx is not null").select("seg", "l_idx", "r_idx", one.alias("single"))
    both = found.where("l_idx = r_idx").select("seg", F.col("l_idx").alias("idx"))
    alone = found.where("single is not null").join(_held(whole, n), "single").where(hamming(F.col("seg"), F.col("ref")) <= budget)
    return both.unionByName(alone.select("seg", F.col("single").alias("idx")))


def split_match(reads: DataFrame, name: str, sequence: Column, start: int, reference: DataFrame, length: int, window: int = 0, budget: int = 3, n: int | None = None) -> DataFrame:
    """`reads` with `name`: both halves of a long segment looked up on their own, each with at most one mismatch.

    Halves that agree are accepted and halves that disagree rejected. A half that matches alone is accepted if the other
    half has no more mismatches than `budget` less its own. Shifts are tried in order; both halves lie at one shift. The
    library is broadcast up to BROADCAST_SEQUENCES sequences; beyond that segments are joined with it, which gives the same.
    """
    half = length // 2
    lib = reference.where("seq is not null")
    n = lib.count() if n is None else n
    agreed = _agreed(lib.select("idx", "seq"), length)
    if n > BROADCAST_SEQUENCES:
        by_parts = lambda segments: _match_split(segments, lib.select("idx", "seq"), length, budget, n)
        return _by_segments(reads, name, F.lit(start), offsets(window), sequence, length, agreed, by_parts, n).drop(f"{name}_shift")
    agreed = F.broadcast(agreed.select(F.col("key").alias("__whole"), F.col("idx").alias("__agreed")))
    left = Index(lib.select("idx", F.substring("seq", 1, half).alias("seq")), half, False, plan_for(n, half), first=False)
    right = Index(lib.select("idx", F.substring("seq", half + 1, length - half).alias("seq")), length - half, False, plan_for(n, length - half), first=False)
    whole = F.broadcast(lib.groupBy(F.col("idx").alias("__one")).agg(F.min("seq").alias("__ref")))

    def hits(rows: DataFrame) -> DataFrame:
        # wholes first, so the halves are those of the other segments
        rows = rows.join(agreed, F.col("__seg") == F.col("__whole"), "left").withColumn("__segment", F.when(F.col("__whole").isNull(), F.col("__seg")))
        segment = F.col("__segment")
        rows = left.hits(rows.withColumn("__seg", F.substring(segment, 1, half)).drop("__whole")).withColumnRenamed("__hit", "__l").drop("__seg")
        rows = right.hits(rows.withColumn("__seg", F.substring(segment, half + 1, length - half))).withColumnRenamed("__hit", "__r").drop("__seg")
        single = F.when(F.col("__l").isNull() | F.col("__r").isNull(), F.coalesce("__l", "__r"))
        rows = rows.withColumn("__single", single).join(whole, F.col("__single") == F.col("__one"), "left")
        hit = F.when(F.col("__l") == F.col("__r"), F.col("__l")).when(F.col("__ref").isNotNull() & (hamming(segment, F.col("__ref")) <= budget), F.col("__single"))
        return rows.withColumn("__hit", F.coalesce("__agreed", hit)).drop("__single", "__one", "__ref", "__l", "__r", "__segment", "__agreed")

    return _searched(reads, name, F.lit(start), offsets(window), sequence, length, hits).drop(f"{name}_shift")


def after_anchor(reads: DataFrame, name: str, sequence: Column, start: int, guides: DataFrame, window: int = 0) -> DataFrame:
    """`reads` with `name`: where an anchor of `guides` (idx, anchor) ends, whose length may vary.

    Anchors are matched with a mismatch; distinct ones are tried in their order (anchor_idx), each at all its shifts.
    """
    anchors = guides.groupBy("anchor").agg(F.min("idx").alias("idx")).withColumn("n", F.length("anchor"))
    counted = {r["n"]: r["count"] for r in anchors.groupBy("n").count().collect()}
    found = reads
    for size in sorted(counted):
        own = anchors.where(F.col("n") == size).select("idx", F.col("anchor").alias("seq"))
        found = lookup(found, f"__a{size}", sequence, start, own, size, window, n=counted[size])
    # of several lengths that match, the anchor listed first
    options = [F.when(F.col(f"__a{size}").isNotNull(), F.struct(F.col(f"__a{size}").alias("i"), (F.lit(start + size) + F.col(f"__a{size}_shift")).alias("at"))) for size in sorted(counted)]
    after = (F.least(*options) if len(options) > 1 else options[0])["at"] if options else F.lit(None).cast("int")
    return found.withColumn(name, after).drop(*(c for size in counted for c in (f"__a{size}", f"__a{size}_shift")))


def anchored_match(reads: DataFrame, name: str, sequence: Column, start: int, guides: DataFrame, length: int, window: int = 0, exact: bool = False, n: int | None = None) -> DataFrame:
    """`reads` with `name` and `name`_end: a guide's protospacer after an anchor whose length may vary.

    The anchor is always matched with a mismatch. The protospacer lies after the anchor and its shift. That the two belong
    to one guide is not asked for. `guides` has idx, anchor, protospacer.
    """
    found = after_anchor(reads, "__after", sequence, start, guides, window)
    found = lookup(found, name, sequence, F.col("__after"), guides.select("idx", F.col("protospacer").alias("seq")), length, window, exact, n=n)
    return found.select(*reads.columns, name, F.when(F.col(name).isNotNull(), F.col("__after") + length).alias(f"{name}_end"))
