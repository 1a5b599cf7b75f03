"""The registered queries over the shared tables, and the same in SQL, written in another way where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexweave.functions import geometry, sequence
from plexweave.operators import assign, droplets, fuzzy, ibu, mapping
from plexweave.plans import fixtures as fx
from plexweave.plans import workflow
from plexweave.sources import sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


V = "varchar"
READS, CRISPR_READS = fx.reads_sql(V), fx.reads_sql(V, "crispr")
WHITELIST, PROBES, GEX, GUIDES = fx.whitelist_sql(V), fx.probes_sql(V), fx.gex_sql(V), fx.guides_sql(V)


def _pack(s: str, n: int) -> str:
    """Two bits a base, the first lowest, in DuckDB."""
    return "(" + " + ".join(f"((instr('ACGT', substr({s}, {i + 1}, 1)) - 1)::bigint << {2 * i})" for i in range(n)) + ")"


def _unpack(v: str, n: int) -> str:
    return "concat(" + ", ".join(f"substr('ACGT', (({v} >> {2 * i}) & 3)::int + 1, 1)" for i in range(n)) + ")"


def _nearest(name: str, segments: str, reference: str) -> str:
    """CTE `name` (seg, idx): brute force over all pairs, an equal sequence first, else the only one at distance 1."""
    return f"""{name} as (select seg, coalesce(min(case when d = 0 then idx end), case when count(*) = 1 then min(idx) end) as idx
      from (select distinct s.seg, r.idx, hamming(s.seg, r.seq) as d from ({segments}) s, ({reference}) r where hamming(s.seg, r.seq) <= 1) group by seg
      having min(d) = 0 or count(*) = 1)"""


def _cut(seq: str, start: str, n: int) -> str:
    return f"case when {start} >= 0 and length({seq}) >= {start} + {n} then substr({seq}, ({start} + 1)::int, {n}) end"


def _shifted(name: str, reads: str, seq: str, start: str, n: int, reference: str, window: int = 1, key: str = "read_id", exact: bool = False) -> str:
    """CTEs ending in `name` (read_id, idx, shift): the first shift that has a match, in the order 0, +1, -1 and so on."""
    order = fuzzy.offsets(window)
    parts = " union all ".join(f"select {key}, {k} as o, {s} as shift, {_cut(seq, f'({start} + {s})', n)} as seg from {reads}" for k, s in enumerate(order))
    near = (
        f"{name}_m as (select seg, min(idx) as idx from (select distinct seg from {name}_s) s join ({reference}) r on r.seq = s.seg group by seg)"
        if exact
        else _nearest(f"{name}_m", f"select distinct seg from {name}_s where seg is not null", reference)
    )
    return f"""{name}_s as ({parts}), {near},
      {name} as (select {key}, arg_min(idx, o) as idx, arg_min(shift, o) as shift from {name}_s join {name}_m using (seg) group by {key})"""


#: The tie rule as conditional sums over windows.
def _count_sql(source: str, strict: bool = False, by: str = "") -> str:
    tie = "nmax > 1" if strict else "nmax > 1 and last_is_max = 1"
    return f"""select {by}barcode, win as index, count(*) as count from (
      select {by}barcode, umi, min(case when c = m then index end) as win, sum(case when c = m then 1 else 0 end) as nmax, max(case when index = li and c = m then 1 else 0 end) as last_is_max
      from (select *, max(c) over (partition by {by}barcode, umi) as m, max(index) over (partition by {by}barcode, umi) as li
        from (select {by}barcode, umi, index, sum(n)::bigint as c from ({source}) group by all)) group by {by}barcode, umi) where not ({tie}) group by {by}barcode, win"""


def _ibu(spark: SparkSession, d: str, sql: str = fx.IBU_SQL, by: tuple[str, ...] = ()) -> DataFrame:
    return ibu.weigh(fx.frame(spark, d, sql), by)


def _features(spark: SparkSession, d: str) -> DataFrame:
    return fx.frame(spark, d, fx.FEATURES_SQL)


def _reads(spark: SparkSession, d: str, kind: str = "gex") -> DataFrame:
    # read pairs are made here; as the rows of a generator they are made once, not again in every filter pushed down
    return fx.frame(spark, d, fx.reads_sql("string", kind), even=True).select(F.inline(F.array(F.struct("*"))))


@query(f"select i.barcode, i.umi, f.unit as feature from ({fx.IBU_PART_SQL}) i left join ({fx.FEATURES_SQL}) f using (index)")
def ibu_view(spark, d):
    return ibu.view(fx.frame(spark, d, fx.IBU_PART_SQL), features=_features(spark, d))


@query(f"select {_unpack('barcode', 16)} as barcode, {_unpack('umi', 12)} as umi, index from ({fx.IBU_SQL})")
def ibu_view_decoded(spark, d):
    return ibu.view(fx.frame(spark, d, fx.IBU_SQL), decoded=True)


@query(f"select barcode, umi, index from ({fx.IBU_SQL})")
def ibu_cat(spark, d):
    rows = fx.frame(spark, d, fx.IBU_SQL)
    return ibu.cat([rows.where(F.col("alias") == a).drop("alias") for a in ("A", "N", "R")], [(16, 12)] * 3)


@query(f"select barcode, umi, index from ({fx.IBU_SQL}) order by all")
def ibu_sort(spark, d):
    return ibu.sort(fx.frame(spark, d, fx.IBU_SQL).drop("alias"))


@query(f"select barcode, count(distinct umi) as n_umis, count(*) as n_reads from ({fx.IBU_SQL}) group by barcode")
def ibu_reads(spark, d):
    return ibu.reads_per_barcode(_ibu(spark, d))


@query(f"select barcode, count(distinct umi) as n_umis, count(*) as n_reads from ({fx.IBU_SQL}) where barcode in (select s_suppkey from supplier where s_acctbal > 0) group by barcode")
def ibu_reads_whitelist(spark, d):
    known = spark.read.parquet(f"{d}/supplier.parquet").where("s_acctbal > 0").select(F.col("s_suppkey").alias("barcode"))
    return ibu.reads_per_barcode(_ibu(spark, d), known)


_ONE = f"select *, 1 as n from ({fx.IBU_SQL})"
_ONE_PART = f"select *, 1 as n from ({fx.IBU_PART_SQL})"


@query(_count_sql(_ONE))
def ibu_count(spark, d):
    return ibu.count(_ibu(spark, d))


@query(_count_sql(_ONE, strict=True))
def ibu_count_strict(spark, d):
    return ibu.count(_ibu(spark, d), ties="strict")


_GENES = f"select barcode, gene, sum(count)::bigint as count from ({_count_sql(_ONE_PART)}) join ({fx.FEATURES_SQL}) using (index) group by barcode, gene"


@query(_GENES)
def count_by_gene(spark, d):
    return ibu.by_aggregate(ibu.count(_ibu(spark, d, fx.IBU_PART_SQL)), _features(spark, d))


@query(f"select concat({_unpack('barcode', 16)}, '-S1') as barcode, gene as feature, count from ({_GENES})")
def count_suffix(spark, d):
    return sinks.count_table(count_by_gene(spark, d), suffix="S1")


@query(f"select barcode, gene as feature, count from ({_GENES})")
def count_encoded(spark, d):
    return sinks.count_table(count_by_gene(spark, d), encoded=True, suffix="S1")


@query(f"select {_unpack('barcode', 16)} as barcode, index, count from ({_count_sql(_ONE_PART)})")
def count_units(spark, d):
    return sinks.count_table(ibu.count(_ibu(spark, d, fx.IBU_PART_SQL)))


@query(f"select {_unpack('barcode', 16)} as barcode, count, index from ({_count_sql(_ONE_PART)})")
def count_units_swapped(spark, d):
    return sinks.count_table(ibu.count(_ibu(spark, d, fx.IBU_PART_SQL)), swapped=True)


@query(f"select count(distinct gene) as n_features, count(distinct barcode) as n_barcodes, count(*) as nnz from ({_GENES})")
def mtx_header(spark, d):
    return sinks.matrix_size(count_by_gene(spark, d))


@query(f"select dense_rank() over (order by gene) as feature_id, dense_rank() over (order by barcode) as barcode_id, count from ({_GENES})")
def mtx_entries(spark, d):
    return sinks.matrix_parts(count_by_gene(spark, d))[2]


@query(f"select alias, count(*) as n from ({fx.IBU_SQL}) group by alias")
def demux_counts(spark, d):
    return fx.frame(spark, d, fx.IBU_SQL).groupBy("alias").agg(F.count("*").alias("n"))


@query(f"select * from ({fx.IBU_SQL}) where alias in (select l_returnflag from lineitem group by 1 having count(*) >= (select ceil(count(*) / 3) from lineitem))")
def sparse_drop(spark, d):
    rows = fx.frame(spark, d, fx.IBU_SQL)
    return ibu.keep_large(rows, at_least=-(-rows.count() // 3))


@query(f"select idx, seq, {_pack('seq', 16)} as packed, seq as back from ({WHITELIST})")
def seq_encode(spark, d):
    rows = fx.frame(spark, d, fx.whitelist_sql("string")).withColumn("packed", sequence.encode(F.col("seq")))
    return rows.withColumn("back", sequence.decode(F.col("packed"), 16))


@query(f"select a.idx as a, b.idx as b, hamming(a.seq, b.seq)::int as packed_distance, hamming(a.seq, b.seq)::int as text_distance from ({WHITELIST}) a join ({WHITELIST}) b on b.idx = a.idx + 1")
def seq_hamming(spark, d):
    rows = fx.frame(spark, d, fx.whitelist_sql("string"))
    both = rows.select(F.col("idx").alias("a"), F.col("seq").alias("s")).join(rows.select((F.col("idx") - 1).alias("a"), F.col("idx").alias("b"), F.col("seq").alias("t")), "a")
    pack = sequence.encode
    return both.select("a", "b", sequence.packed_hamming(pack(F.col("s")), pack(F.col("t"))).alias("packed_distance"), sequence.hamming(F.col("s"), F.col("t")).alias("text_distance"))


@query(
    f"""select idx, seq as variant from ({WHITELIST}) union all select idx, concat(substr(seq, 1, (i - 1)::int), c, substr(seq, (i + 1)::int)) as variant
    from ({WHITELIST}), range(1, 17) t(i), (values ('A'), ('C'), ('G'), ('T')) v(c) where c <> substr(seq, i::int, 1)"""
)
def seq_variants(spark, d):
    return fx.frame(spark, d, fx.whitelist_sql("string")).select("idx", F.explode(sequence.variants(F.col("seq"), 16)).alias("variant"))


@query(f"select read_id, case when length(r1_seq) >= 28 then {_pack('substr(r1_seq, 17, 12)', 12)} end as umi from ({READS})")
def umi_extract(spark, d):
    return _reads(spark, d).select("read_id", sequence.encode(sequence.piece(F.col("r1_seq"), 16, 12)).alias("umi"))


@query(f"select read_id, length(r1_qual) < 28 or not regexp_matches(substr(r1_qual, 17, 12), '[!-*]') as passes from ({READS})")
def umi_quality(spark, d):
    return _reads(spark, d).select("read_id", sequence.quality_passes(F.col("r1_qual"), 16, 12).alias("passes"))


def _whitelisted(spark, d, window, exact=False, plan="auto"):
    known = fx.frame(spark, d, fx.whitelist_sql("string"))
    return fuzzy.lookup(_reads(spark, d).select("read_id", "r1_seq"), "idx", F.col("r1_seq"), 0, known, 16, window, exact, plan).select("read_id", "idx", F.col("idx_shift").alias("shift"))


def _whitelist_oracle(window: int, exact: bool = False) -> str:
    return f"with rd as ({READS}), {_shifted('w', 'rd', 'r1_seq', '0', 16, WHITELIST, window, exact=exact)} select read_id, idx, shift from rd left join w using (read_id)"


@query(_whitelist_oracle(0, True))
def whitelist_exact(spark, d):
    return _whitelisted(spark, d, 0, True)


@query(_whitelist_oracle(0))
def whitelist_hd1(spark, d):
    return _whitelisted(spark, d, 0)


@query(_whitelist_oracle(0))
def whitelist_hd1_halves(spark, d):
    return _whitelisted(spark, d, 0, plan="halves")


@query(_whitelist_oracle(0))
def whitelist_hd1_misses(spark, d):
    return _whitelisted(spark, d, 0, plan="misses")


@query(_whitelist_oracle(1))
def whitelist_remap(spark, d):
    return _whitelisted(spark, d, 1)


def _libraries(spark, d, kind="gex", pattern=None):
    probes = fx.frame(spark, d, fx.probes_sql("string"))
    return mapping.Libraries(
        fx.frame(spark, d, fx.whitelist_sql("string")).select("seq"),
        fx.frame(spark, d, fx.gex_sql("string")) if kind == "gex" else None,
        fx.frame(spark, d, fx.guides_sql("string")) if kind == "crispr" else None,
        mapping.keep_aliases(probes, pattern) if pattern else probes,
    )


GEX_GEOMETRY = geometry.PRESETS["gex-v1"]
CRISPR_GEOMETRY = "[barcode][umi:12] | [anchor][protospacer][:12][probe]"


def _flags(spark, d, kind="gex", pattern=None):
    text = GEX_GEOMETRY if kind == "gex" else CRISPR_GEOMETRY
    return mapping.flagged(_reads(spark, d, kind), geometry.parse(text), _libraries(spark, d, kind, pattern))


def _halves_oracle(window: int = 1) -> str:
    """CTE `feat` (read_id, idx): a whole segment of 50 is judged by both halves, at each shift."""
    order = fuzzy.offsets(window)
    parts = " union all ".join(f"select read_id, {k} as o, {_cut('r2_seq', f'({s})', 50)} as seg from rd" for k, s in enumerate(order))
    left, right = f"select idx, substr(seq, 1, 25) as seq from ({GEX})", f"select idx, substr(seq, 26) as seq from ({GEX})"
    return f"""fs as ({parts}), {_nearest('hl', 'select distinct substr(seg, 1, 25) as seg from fs where seg is not null', left)},
      {_nearest('hr', 'select distinct substr(seg, 26) as seg from fs where seg is not null', right)},
      fj as (select s.seg, hl.idx as li, hr.idx as ri from (select distinct seg from fs where seg is not null) s
        left join hl on hl.seg = substr(s.seg, 1, 25) left join hr on hr.seg = substr(s.seg, 26)),
      fa as (select seg, coalesce(li, ri) as idx from fj join ({GEX}) g on g.idx = coalesce(li, ri)
        where (li = ri) or ((li is null or ri is null) and hamming(seg, g.seq) <= 3)),
      feat as (select read_id, arg_min(idx, o) as idx from fs join fa using (seg) group by read_id)"""


@query(f"with rd as ({READS}), {_halves_oracle()} select read_id, feat.idx as feature from rd left join feat using (read_id)")
def gex_split_map(spark, d):
    return fuzzy.split_match(_reads(spark, d).select("read_id", "r2_seq"), "feature", F.col("r2_seq"), 0, fx.frame(spark, d, fx.gex_sql("string")), 50, 1).drop("r2_seq")


def _anchored_oracle(window: int = 1) -> str:
    """CTE `feat` (read_id, idx, stop): anchors by length, the one listed first wins; then the protospacer."""
    lengths = sorted({len(a) for a in fx.ANCHORS})
    own = {n: f"select min(idx) as idx, anchor as seq from ({GUIDES}) where length(anchor) = {n} group by anchor" for n in lengths}
    ctes = ", ".join(_shifted(f"an{n}", "rd", "r2_seq", "0", n, own[n], window) for n in lengths)
    union = " union all ".join(f"select read_id, idx, {n} + shift as after from an{n}" for n in lengths)
    return f"""{ctes}, aa as (select read_id, arg_min(after, idx) as after from ({union}) group by read_id),
      ra as (select rd.*, aa.after from rd join aa using (read_id)),
      {_shifted('ps', 'ra', 'r2_seq', 'after', 20, f'select idx, protospacer as seq from ({GUIDES})', window)},
      feat as (select read_id, ps.idx, after + 20 as stop from ps join aa using (read_id))"""


@query(f"with rd as ({CRISPR_READS}), {_anchored_oracle()} select read_id, feat.idx as feature, feat.stop::int as feature_end from rd left join feat using (read_id)")
def crispr_anchor_map(spark, d):
    return fuzzy.anchored_match(_reads(spark, d, "crispr").select("read_id", "r2_seq"), "feature", F.col("r2_seq"), 0, fx.frame(spark, d, fx.guides_sql("string")), 20, 1).drop("r2_seq")


def _flags_oracle(kind: str, pattern: str | None = None) -> str:
    """CTEs ending in `fl`: each read's feature, barcode, UMI, alias, and reasons."""
    probes = f"select row_number() over (order by seq) as idx, seq, alias from ({PROBES})" + (f" where regexp_matches(alias, '{pattern}')" if pattern else "")
    reads, feature = (READS, _halves_oracle()) if kind == "gex" else (CRISPR_READS, _anchored_oracle())
    start = "68" if kind == "gex" else "stop + 12"
    return f"""rd as ({reads}), {feature}, {_shifted('w', 'rd', 'r1_seq', '0', 16, WHITELIST)},
      rf as (select rd.*, feat.idx as feature{', feat.stop' if kind == 'crispr' else ''} from rd left join feat using (read_id)),
      pr as ({probes}), {_shifted('pb', 'rf', 'r2_seq', start, 8, 'select idx, seq from pr')},
      fl as (select rf.read_id, feature, wl.seq as bc, case when length(r1_seq) >= 28 then substr(r1_seq, 17, 12) end as umi, pr.alias,
        feature is null as missing_feature, wl.seq is null as missing_whitelist, length(r1_seq) < 28 as umi_truncated,
        length(r1_qual) >= 28 and regexp_matches(substr(r1_qual, 17, 12), '[!-*]') as failed_umi_qual, pr.alias is null as missing_probe
        from rf left join w using (read_id) left join ({WHITELIST}) wl on wl.idx = w.idx left join pb on pb.read_id = rf.read_id left join pr on pr.idx = pb.idx)"""


_OK = "not (missing_feature or missing_whitelist or umi_truncated or failed_umi_qual or missing_probe)"
_RECORDS = f"select alias, {_pack('bc', 16)} as barcode, {_pack('umi', 12)} as umi, feature as index, count(*) as n_reads from fl where {_OK} group by all"


@query(f"with {_flags_oracle('gex')} select alias, count(*) as n from fl where not missing_probe group by alias")
def probe_demux(spark, d):
    return _flags(spark, d).where("not missing_probe").groupBy("alias").agg(F.count("*").alias("n"))


@query(f"with {_flags_oracle('crispr')} select alias, count(*) as n from fl where not missing_probe group by alias")
def probe_dynamic(spark, d):
    return _flags(spark, d, "crispr").where("not missing_probe").groupBy("alias").agg(F.count("*").alias("n"))


@query(f"with {_flags_oracle('gex', '[AR]')} select alias, count(*) as n from fl where not missing_probe group by alias")
def probe_regex(spark, d):
    return _flags(spark, d, pattern="[AR]").where("not missing_probe").groupBy("alias").agg(F.count("*").alias("n"))


def _stats_oracle(kind: str) -> str:
    reasons = ", ".join(f"sum({r}::int)::bigint as {r}" for r in mapping.REASONS)
    fractions = ", ".join(f"case when mapped_reads = total_reads then 0 else {r} / (total_reads - mapped_reads) end as fraction_{r}" for r in mapping.REASONS)
    return f"""with {_flags_oracle(kind)}, st as (select count(*) as total_reads, sum(({_OK})::int)::bigint as mapped_reads, {reasons} from fl)
      select total_reads, mapped_reads, total_reads - mapped_reads as unmapped_reads, {", ".join(mapping.REASONS)}, mapped_reads / total_reads as fraction_mapped,
        (total_reads - mapped_reads) / total_reads as fraction_unmapped, {fractions} from st"""


@query(_stats_oracle("gex"))
def map_stats(spark, d):
    return mapping.statistics(_flags(spark, d))


@query(_stats_oracle("crispr"))
def map_stats_crispr(spark, d):
    return mapping.statistics(_flags(spark, d, "crispr"))


@query(f"with {_flags_oracle('gex')} {_RECORDS}")
def map_gex(spark, d):
    return mapping.records(_flags(spark, d))


@query(f"with {_flags_oracle('crispr')} {_RECORDS}")
def map_crispr(spark, d):
    return mapping.records(_flags(spark, d, "crispr"))


def _components_sql(source: str, by: str = "") -> str:
    """CTEs ending in `uc` (…, umi, n, corrected): components by recursion, the UMI with most reads of each, ties to the largest."""
    keys = f"{by}barcode, index"
    same = " and ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    both = ", ".join(f"a.{k}" for k in keys.split(", "))
    x = "xor(a.umi, b.umi)"
    reach = " and ".join(f"r.{k} = e.{k}" for k in keys.split(", "))
    return f"""un as (select {keys}, umi, sum(n)::bigint as n from ({source}) group by all),
      ed as (select {both}, a.umi as x, b.umi as y from un a join un b on {same} and a.umi <> b.umi and bit_count(({x} | ({x} >> 1)) & 6148914691236517205) <= 1),
      re as (select {keys}, umi as x, umi as y from un union select {', '.join(f'r.{k}' for k in keys.split(', '))}, r.x, e.y from re r join ed e on {reach} and r.y = e.x),
      cc as (select {keys}, x as umi, min(y) as comp from re group by {keys}, x),
      uc as (select *, first_value(umi) over (partition by {keys}, comp order by n desc, umi desc) as corrected from un join cc using ({keys}, umi))"""


_UMI = f"select *, 1 as n from ({fx.IBU_UMI_SQL})"


@query(f"with recursive {_components_sql(_UMI)} select barcode, corrected as umi, index, sum(n)::bigint as n_reads from uc group by all")
def umi_correct(spark, d):
    return ibu.umi_correct(_ibu(spark, d, fx.IBU_UMI_SQL))


@query(
    f"""with recursive {_components_sql(_UMI)} select sum(n)::bigint as total, sum(case when umi <> corrected then n else 0 end)::bigint as corrected,
    sum(case when umi <> corrected then n else 0 end) / sum(n) as fraction_corrected from uc"""
)
def umi_stats(spark, d):
    return ibu.umi_stats(ibu.umi_clusters(_ibu(spark, d, fx.IBU_UMI_SQL)))


@query("select count(*) as total_elem, count(distinct p_brand) as total_aggr, count(distinct p_partkey) as total_hash from part")
def library_stats(spark, d):
    library = fx.frame(spark, d, fx.gex_sql("string")).join(_features(spark, d).withColumnRenamed("index", "idx"), "idx")
    return mapping.library_statistics(library, "seq", "gene")


@query("select p_brand, row_number() over (order by first) - 1 as index from (select p_brand, min(p_partkey) as first from part group by p_brand)")
def bijection(spark, d):
    return ibu.bijection(spark.read.parquet(f"{d}/part.parquet"), "p_brand", "p_partkey")


_GUIDE_COUNTS = f"select l_suppkey as barcode, p_size::bigint as index, count(*) as count from lineitem join part on p_partkey = l_partkey group by all"
#: The same with some pairs raised, so that tests have something to find.
_RAISED = f"select barcode, index, (count * case when barcode % 10 = index % 10 then 6 else 1 end)::bigint as count from ({_GUIDE_COUNTS})"


def _tests(counts: str) -> str:
    return f"""gc as ({counts}), ok as (select * from gc where barcode in (select barcode from gc group by 1 having sum(count) >= 5)),
  og as (select * from ok where index in (select index from ok group by 1 having sum(count) >= 5)),
  tt as (select *, sum(count) over (partition by barcode)::double as n, sum(count) over (partition by index)::double as k, sum(count) over ()::double as m from og),
  ex as (select *, unnest(range(count, least(n, k)::bigint + 1)) as j from tt),
  pv as (select barcode, index, count, least(1, sum(exp(lgamma(k+1)-lgamma(j+1)-lgamma(k-j+1)+lgamma(m-k+1)-lgamma(n-j+1)-lgamma(m-k-n+j+1)-lgamma(m+1)+lgamma(n+1)+lgamma(m-n+1)))) as p
    from ex group by all),
  rk as (select *, count(*) over (order by p range unbounded preceding) as r, count(*) over () as c from pv),
  bh as (select *, min(least(1, p * c / r)) over (order by p desc range unbounded preceding) as q from rk)"""




def _guide_counts(spark, d, raised=False):
    part = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").cast("long").alias("index"))
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", F.col("l_suppkey").alias("barcode"))
    counts = lines.join(part, "l_partkey").groupBy("barcode", "index").agg(F.count("*").alias("count"))
    return counts.withColumn("count", F.col("count") * F.when(F.col("barcode") % 10 == F.col("index") % 10, 6).otherwise(1)) if raised else counts


@query(f"with {_tests(_GUIDE_COUNTS)} select barcode, index, count, round(p, 4) as p_value, round(q, 4) as fdr from bh where q <= 1")
def guide_assign(spark, d):
    found = assign.assign_guides(_guide_counts(spark, d), fdr=1.0)
    return found.withColumn("p_value", F.round("p_value", 4)).withColumn("fdr", F.round("fdr", 4))


@query(f"with {_tests(_RAISED)} select barcode, index, count, round(p, 9) as p_value, round(q, 9) as fdr from bh where q <= 0.05")
def guide_assign_cut(spark, d):
    found = assign.assign_guides(_guide_counts(spark, d, True))
    return found.withColumn("p_value", F.round("p_value", 9)).withColumn("fdr", F.round("fdr", 9))


@query(f"with {_tests(_RAISED)} select bh.barcode, bh.index, bh.count from bh join tt using (barcode, index) where log2(bh.count / tt.n / (tt.k / tt.m)) >= 0.5")
def guide_assign_odds(spark, d):
    return assign.assign_guides(_guide_counts(spark, d, True), fdr=1.0, min_log_odds=0.5).select("barcode", "index", "count")


def _droplets_oracle(ambient_most: int) -> str:
    """The deviance from the ambient profile, added by index, its chi-square tail by the same normal form, and false discovery rates."""
    return f"""with gc as ({_GUIDE_COUNTS}), t as (select barcode, sum(count)::bigint as total from gc group by 1),
      low as (select index, sum(count) as a from gc join t using (barcode) where total <= {ambient_most} group by 1),
      pr as (select g.index, coalesce(a, 0) + 1 as a from (select distinct index from gc) g left join low using (index)),
      w as (select sum(a)::double as whole, count(*) as n_genes from pr),
      dv as (select barcode, total, sum(2 * count * ln(count / (total * a / whole)) order by index) as deviance, greatest(1, least(total, any_value(n_genes)) - 1)::double as free
        from gc join t using (barcode) join pr using (index), w where total > {ambient_most} group by barcode, total),
      zs as (select *, (cbrt(greatest(0, deviance) / free) - (1 - 2 / (9 * free))) / sqrt(2 / (9 * free)) as z from dv),
      ts as (select *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) as u from zs),
      hs as (select *, 0.5 * u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-z * z / 2) as half from ts),
      pv as (select barcode, total, deviance, case when z >= 0 then half else 1 - half end as p from hs),
      rk as (select *, count(*) over (order by p range unbounded preceding) as r, count(*) over () as c from pv),
      bh as (select *, min(least(1, p * c / r)) over (order by p desc range unbounded preceding) as q from rk)
      select barcode, total, round(deviance, 6) as deviance, round(p, 9) as p_value, round(q, 9) as fdr, q <= 0.01 as is_cell from bh"""


def _droplets(spark, d, **options):
    found = assign.droplet_filter(_guide_counts(spark, d), **options)
    return found.withColumns({"deviance": F.round("deviance", 6), "p_value": F.round("p_value", 9), "fdr": F.round("fdr", 9)})


@query(_droplets_oracle(100))
def droplet_filter(spark, d):
    return _droplets(spark, d)


@query(_droplets_oracle(600))
def droplet_filter_ambient(spark, d):
    return _droplets(spark, d, ambient_most=600)


#: Each step works out both parts of every guide anew from its bins; the last step's are the fit.
_MIXTURE = f"""mc as ({_RAISED}), mk as (select * from mc where barcode in (select barcode from mc group by 1 having sum(count) >= 3)),
  mo as (select * from mk where index in (select index from mk group by 1 having sum(count) >= 5)),
  mb as (select index, ln(count) as x, count(*)::double as n from mo group by index, count),
  m0 as (select index, sum(n) as cells, min(x) as low, max(x) as high, sum(n * x) / sum(n) as mean from mb group by 1 having count(*) > 1),
  em as (select m.index, 0 as k, 0.5::double as s, any_value(low) as l, any_value(high) as h, sum(n * (x - mean) ** 2) / any_value(cells) + 0.001 as vl, sum(n * (x - mean) ** 2) / any_value(cells) + 0.001 as vh
      from m0 m join mb using (index) group by m.index
    union all select index, k + 1, u / (u + d), dx / d, ux / u, (dxx - dx * dx / d) / d + 0.001, (uxx - ux * ux / u) / u + 0.001 from (
      select index, any_value(k) as k, sum(n * p) as u, sum(n * (1 - p)) as d, sum(n * p * x) as ux, sum(n * (1 - p) * x) as dx, sum(n * p * x * x) as uxx, sum(n * (1 - p) * x * x) as dxx
      from (select e.index, k, x, n, 1 / (1 + exp(-(ln(s / (1 - s)) + ln(vl / vh) / 2 - (x - h) ** 2 / (2 * vh) + (x - l) ** 2 / (2 * vl)))) as p from em e join mb on mb.index = e.index where k < 300) group by index)),
  fit as (select * from em where k = 300)"""


@query(f"with recursive {_MIXTURE} select index, round(s, 6) as share, round(l, 6) as mean_low, round(h, 6) as mean_high, round(vl, 6) as var_low, round(vh, 6) as var_high from fit")
def guide_mixtures(spark, d):
    rows = assign._frequent(_guide_counts(spark, d, True), 3, 5, [])
    return assign.guide_mixtures(rows).select("index", *(F.round(c, 6).alias(c) for c in ("share", "mean_low", "mean_high", "var_low", "var_high")))


@query(
    f"""with recursive {_MIXTURE}, pp as (select barcode, index, count, l, 1 / (1 + exp(-(ln(s / (1 - s)) + ln(vl / vh) / 2 - (ln(count) - h) ** 2 / (2 * vh) + (ln(count) - l) ** 2 / (2 * vl)))) as p
      from mo join fit using (index)) select barcode, index, count, round(p, 6) as posterior from pp where p > 0.5 and ln(count) > l"""
)
def guide_assign_mixture(spark, d):
    return assign.assign_by_mixture(_guide_counts(spark, d, True)).withColumn("posterior", F.round("posterior", 6))


def _good_turing(counts: str, lower: int) -> str:
    """CTEs ending in `share` (index, share): simple Good-Turing estimates over windows, the line by a regression."""
    return f"""gc as ({counts}), t as (select barcode, sum(count)::bigint as total from gc group by 1),
      am as (select g.index, coalesce(sum(case when total <= {lower} then count end), 0) as a from gc g join t using (barcode) group by g.index),
      ff as (select a as r, count(*)::double as n from am where a > 0 group by 1),
      sp as (select r, n, coalesce(lag(r) over w, 0) as b, lead(r) over w as e from ff window w as (order by r)),
      zz as (select r, n, ln(r) as x, ln(2 * n / (coalesce(e, 2 * r - b) - b)) as y from sp),
      ln as (select coalesce(regr_slope(y, x), -1) as slope from zz),
      cl as (select z.r, z.n, z.r * (1 + 1 / z.r) ** (slope + 1) as smooth, (z.r + 1) * coalesce(f.n, 0) / z.n as raw, coalesce(f.n, 0) as n1 from zz z cross join ln left join ff f on f.r = z.r + 1),
      st as (select *, min((n1 > 0 and abs(smooth - raw) > 1.96 * sqrt((r + 1) ** 2 * n1 / n ** 2 * (1 + n1 / n)))::int) over (order by r) as as_is from cl),
      ad as (select r, n, case when as_is = 1 then raw else smooth end as rs from st),
      tw as (select sum(r * n) as whole, sum(rs * n) as norm, coalesce(sum(case when r = 1 then n end), 0) / sum(r * n) as p1, (select count(*) from am where a = 0) as zeros from ad),
      un as (select *, case when zeros = 0 then 0 when p1 > 0 and p1 < 1 then p1 else 1 / (1 + whole) end as unseen from tw),
      share as (select am.index, case when am.a = 0 then unseen / zeros else (1 - unseen) * rs / norm end as share from am cross join un left join ad on ad.r = am.a)"""


@query(f"with {_good_turing(_GUIDE_COUNTS, 600)} select index, round(share, 9) as share from share")
def ambient_profile(spark, d):
    return droplets.ambient_profile(_guide_counts(spark, d), lower=600).withColumn("share", F.round("share", 9))


#: A profile with genes that no ambient barcode has, and others seen once.
_RARE = f"select barcode, index, count from ({_GUIDE_COUNTS}) where (barcode * 31 + index * index) % 7 < index % 8"


@query(f"with {_good_turing(_RARE, 350)} select index, round(share, 9) as share from share")
def ambient_profile_rare(spark, d):
    rows = _guide_counts(spark, d).where("(barcode * 31 + index * index) % 7 < index % 8")
    return droplets.ambient_profile(rows, lower=350).withColumn("share", F.round("share", 9))


@query(
    f"""with {_good_turing(_GUIDE_COUNTS, 600)} select barcode, sum(count)::bigint as total,
      round(sum(lgamma(count + 50 * share) - lgamma(50 * share) - lgamma(count + 1)), 6) as loglik from gc join share using (index) group by barcode"""
)
def droplet_likelihoods(spark, d):
    counts = _guide_counts(spark, d)
    return droplets.likelihoods(counts, droplets.ambient_profile(counts, lower=600), 50.0).withColumn("loglik", F.round("loglik", 6))


@query(
    """with n as (select total, count(*)::double as n from (select l_suppkey, l_linenumber, count(*) as total from lineitem where l_suppkey % 7 > l_linenumber % 3 group by all) where total > 10 group by total),
      c as (select total, log10(sum(n) over (order by total desc) - (n - 1) / 2) as x, log10(total) as y, row_number() over (order by total desc) as i from n),
      s as (select i, (lead(y) over w - y) / (lead(x) over w - x) as slope from c window w as (order by i)),
      e as (select arg_min(i, struct_pack(s := slope, i := i)) + 1 as stop from s where slope is not null),
      a as (select * from c where i = 1), z as (select c.* from c, e where i = stop),
      h as (select c.total, c.i, (c.y - a.y) * (z.x - a.x) - (z.y - a.y) * (c.x - a.x) as height from c, a, z, e where c.i <= stop)
      select arg_max(total, struct_pack(h := height, i := -i))::bigint as knee from h"""
)
def droplet_knee(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet").where("l_suppkey % 7 > l_linenumber % 3")
    totals = lines.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("total")).withColumnRenamed("l_suppkey", "barcode")
    return droplets.knee_points(totals, lower=10)


#: Two genes: then a droplet is the number of its molecules of the second, and all droplets of a total can be listed.
_TWO = f"select barcode, index % 2 as index, sum(count * case when barcode % 10 = 3 and index % 2 = 1 then 8 else 1 end)::bigint as count from ({_GUIDE_COUNTS}) group by all"


@query(
    f"""with {_good_turing(_TWO, 600)}, sh as (select max(case when index = 1 then share end) * 200 as a1, max(case when index = 0 then share end) * 200 as a0 from share),
      ob as (select barcode, total, coalesce(max(case when index = 1 then count end), 0) as k from gc join t using (barcode) where total > 600 group by all),
      dm as (select total, j, lgamma(j + a1) - lgamma(a1) - lgamma(j + 1) + lgamma(total - j + a0) - lgamma(a0) - lgamma(total - j + 1) as l, a0, a1
        from (select total, unnest(range(total + 1)) as j from (select distinct total from ob)), sh),
      pr as (select *, exp(l + lgamma(total + 1) + lgamma(200) - lgamma(total + 200)) as p from dm),
      ex as (select ob.barcode, ob.total, sum(case when x.l <= o.l + 1e-9 * abs(o.l) then x.p else 0 end) as p from ob join pr o on o.total = ob.total and o.j = ob.k join pr x on x.total = ob.total group by all),
      rk as (select *, count(*) over (order by p range unbounded preceding) as r, count(*) over () as c from ex),
      bh as (select *, min(least(1, p * c / r)) over (order by p desc range unbounded preceding) as q from rk)
      select barcode, total, q <= 0.01 as is_cell from bh"""
)
def empty_drops_two(spark, d):
    """Cells by simulation; the SQL lists all droplets of each total."""
    counts = _guide_counts(spark, d)
    raised = F.when((F.col("barcode") % 10 == 3) & (F.col("index") % 2 == 1), 8).otherwise(1)
    two = counts.groupBy("barcode", (F.col("index") % 2).alias("index")).agg(F.sum(F.col("count") * raised).cast("long").alias("count"))
    return droplets.empty_drops(two, lower=600, retain=None, alpha=200.0).select("barcode", "total", "is_cell")


@query()
def empty_drops(spark, d):
    """Without SQL: the overdispersion is fitted, and p values are simulated; tests hold both against exact values."""
    return droplets.empty_drops(_guide_counts(spark, d, True), lower=700)


def _pipeline_oracle(kind: str) -> str:
    fixed = f"select alias, barcode, index, corrected as umi, n from uc"
    return f"""with recursive {_flags_oracle(kind)}, rc as ({_RECORDS}), big as (select alias from rc group by alias having sum(n_reads) >= 1000),
      {_components_sql("select alias, barcode, umi, index, n_reads as n from rc where alias in (select alias from big)", "alias, ")},
      ct as ({_count_sql(fixed, by="alias, ")})
      select alias, barcode, gene, sum(count)::bigint as count from ct join ({fx.FEATURES_SQL}) f using (index) group by all"""


def _workflow(spark, d, kind):
    text = GEX_GEOMETRY if kind == "gex" else CRISPR_GEOMETRY
    return workflow.run(_reads(spark, d, kind), geometry.parse(text), _libraries(spark, d, kind), _features(spark, d), finish=False)


@query(_pipeline_oracle("gex"))
def pipeline_gex(spark, d):
    return _workflow(spark, d, "gex").counts


@query(_pipeline_oracle("crispr"))
def pipeline_crispr(spark, d):
    return _workflow(spark, d, "crispr").counts
