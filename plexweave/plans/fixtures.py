"""Sequencing data derived from the shared tables; the same expressions serve Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plexweave.session import spread

SPACER = "ACGTACGTACGTACGTAC"
ANCHORS = ("GTTTAGAGCTA", "GCTATGCTGTTTC", "CACCGAAACGGTGCT")


def dna(tag: str, key: str, n: int, text: str) -> str:
    """A sequence of up to 32 bases from a key; `text` is the engine's string type."""
    return f"translate(substr(md5(concat('{tag}', cast({key} as {text}))), 1, {n}), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def _changed(s: str, *places: int) -> str:
    """`s` with each of the places changed, in ascending order."""
    parts, at = [], 1
    for p in places:
        parts += [f"substr({s}, {at}, {p - at})", f"translate(substr({s}, {p}, 1), 'ACGT', 'CGTA')"]
        at = p + 1
    return f"concat({', '.join(parts)}, substr({s}, {at}))"


def _read_id(text: str) -> str:
    """All that a read is made of, so reads of one id are the same."""
    parts = ", '-', ".join(f"cast({c} as {text})" for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    return f"concat({parts})"


def reads_sql(text: str, feature: str = "gex") -> str:
    """Read pairs from lineitem. By l_orderkey % 12: 0 as is; barcode with 1 one change, 2 two, 3 shifted by one, 4 read 1 too
    short, 5 a UMI base of low quality, 6 an unknown barcode; feature with 7 one change, 8 two in one half, 9 four, 10 halves of
    two features; 11 a change in the probe."""
    if feature == "gex":
        r2 = f"""concat(case k when 7 then {_changed("f", 10)} when 8 then {_changed("f", 10, 12)} when 9 then {_changed("f", 3, 7, 11, 15)}
          when 10 then concat(substr(f, 1, 25), g) else f end, '{SPACER}', case k when 11 then {_changed("p", 3)} else p end)"""
    else:
        r2 = f"""concat(a, case k when 7 then {_changed("f", 10)} when 8 then {_changed("f", 10, 12)} else f end, 'ACGTACGTACGT',
          case k when 11 then {_changed("p", 3)} else p end)"""
    anchors = "case l_partkey % 3 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ANCHORS)) + " end"
    f = f"concat({dna('gl:', 'l_partkey', 25, text)}, {dna('gr:', 'l_partkey', 25, text)})" if feature == "gex" else dna("ps:", "l_partkey", 20, text)
    return f"""
      select read_id, r1 as r1_seq, {r2} as r2_seq, case k when 5 then concat(repeat('I', 19), '#', repeat('I', 8)) else repeat('I', cast(length(r1) as int)) end as r1_qual,
        repeat('I', 76) as r2_qual
      from (select *, case k when 3 then concat('G', bc, u) when 4 then substr(concat(bc, u), 1, 20) else concat(bc, u) end as r1
        from (select read_id, k, f, g, p, a, u, case k when 1 then {_changed("b", 5)} when 2 then {_changed("b", 5, 9)} when 6 then translate(b, 'ACGT', 'TGCA') else b end as bc
          from (select {_read_id(text)} as read_id, l_orderkey % 12 as k, {dna('bc:', 'l_suppkey', 16, text)} as b, {dna('umi:', 'l_orderkey', 12, text)} as u,
            {f} as f, {dna('gr:', 'l_partkey + 1', 25, text)} as g, {dna('pr:', 'l_returnflag', 8, text)} as p, {anchors} as a from lineitem) x) y) z"""


def whitelist_sql(text: str) -> str:
    return f"select s_suppkey as idx, {dna('bc:', 's_suppkey', 16, text)} as seq from supplier"


def probes_sql(text: str) -> str:
    return f"select {dna('pr:', 'l_returnflag', 8, text)} as seq, l_returnflag as alias from (select distinct l_returnflag from lineitem) flags"


def gex_sql(text: str) -> str:
    return f"select p_partkey as idx, concat({dna('gl:', 'p_partkey', 25, text)}, {dna('gr:', 'p_partkey', 25, text)}) as seq from part"


def guides_sql(text: str) -> str:
    anchors = "case p_partkey % 3 " + " ".join(f"when {i} then '{a}'" for i, a in enumerate(ANCHORS)) + " end"
    return f"select p_partkey as idx, {anchors} as anchor, {dna('ps:', 'p_partkey', 20, text)} as protospacer from part"


FEATURES_SQL = "select p_partkey as index, concat('P', p_partkey) as unit, p_brand as gene from part"
IBU_SQL = "select l_suppkey as barcode, l_partkey % 50 as umi, cast(l_linenumber as bigint) as index, l_returnflag as alias from lineitem"
IBU_PART_SQL = "select l_suppkey as barcode, l_orderkey % 4096 as umi, l_partkey as index, l_returnflag as alias from lineitem"
IBU_UMI_SQL = "select l_suppkey as barcode, l_orderkey % 4096 as umi, cast(l_linenumber as bigint) as index from lineitem"


def frame(spark: SparkSession, sf_dir: str, sql: str, even: bool = False) -> DataFrame:
    """One of the statements above over the tables of a folder, these spread over all cores if `even`."""
    import re

    views = {}
    for name in ("lineitem", "supplier", "part"):
        if re.search(rf"\bfrom {name}\b", sql):
            rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            views[name] = spread(rows) if even else rows
            sql = re.sub(rf"\bfrom {name}\b", f"from {{{name}}}", sql)
    return spark.sql(sql, **views)
