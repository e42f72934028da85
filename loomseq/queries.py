"""The registered queries of the core operators, and SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions import dna
from loomseq.operators import hits as H
from loomseq.operators import intervals, matrix, stats
from loomseq.session import table
from loomseq.sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with SQL for the same rows where SQL can express it."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def hits(spark: SparkSession, d: str) -> DataFrame:
    return H.clean_hits(table(spark, d, "alignments"))


def r6(c: Column | str) -> Column:
    """Six digits; the small term keeps values that lie between two of them from falling to either side."""
    return F.round((F.col(c) if isinstance(c, str) else c) + 1e-9, 6)


_HITS = """hits as (
  select * replace (upper(trim(database_id)) as database_id,
    case when similarity > 1 then similarity / 100
         else coalesce(similarity, case when least(q_len, t_len) > 0 then greatest(0.0, 1 - nm / least(q_len, t_len)::double) end) end as similarity)
  from alignments where hit_id is not null
  qualify row_number() over (partition by hit_id order by loaded_at desc nulls last, as_score desc nulls last, nm nulls last) = 1)"""
_READS = "reads as (select * from ont_reads where id is not null and sequence is not null qualify row_number() over (partition by id order by loaded_at desc) = 1)"
_ISLANDS = """reach as (select *, max(q_end) over (partition by query_id order by q_start, hit_id rows between unbounded preceding and 1 preceding) as reach from hits),
flagged as (select *, case when reach is null or q_start > reach or (q_start > reach - {t} and q_end - q_start > 2 * {t}) then 1 else 0 end as opens from reach),
numbered as (select *, sum(opens) over (partition by query_id order by q_start, hit_id rows unbounded preceding)::bigint as cluster_num from flagged),
counted as (select *, count(*) over (partition by query_id, cluster_num) as cluster_item_count from numbered)"""
_RESOLVED = (
    _ISLANDS
    + """,
lists as (select query_id, cluster_num, list({{v: as_score, a: q_start, t: hit_id, b: q_end}} order by as_score desc nulls last, q_start desc, hit_id desc) as l
  from counted where cluster_item_count > 1 and q_end - q_start > 2 * {t} group by query_id, cluster_num),
kept as (select query_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, x:
    case when len(list_filter(acc, lambda y: y.b >= x[1].a + {t} and y.a <= x[1].b - {t})) > 0 then acc else list_concat(acc, x) end)).t as hit_id from lists),
resolved as (select * from counted where cluster_item_count = 1 or hit_id in (select hit_id from kept))"""
)


# --- scalar functions over whole sequence tables -----------------------------------------------------------------------


def reads(spark: SparkSession, d: str) -> DataFrame:
    """Each read once, the latest load."""
    rows = table(spark, d, "ont_reads").where("id is not null and sequence is not null")
    return H.best_hits(rows.withColumn("_at", F.unix_micros(F.col("loaded_at").cast("timestamp"))), ["id"], "_at", "sequence").drop("_at")


@query("select id, reverse(translate(upper(sequence), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) as sequence, not regexp_matches(upper(coalesce(sequence, '')), '[^ATGCRYKMBVDHSWN -]') as valid from ref_db where sequence is not null")
def revcomp(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ref_db").where("sequence is not null")
    return t.select("id", dna.revcomp(F.col("sequence")).alias("sequence"), dna.is_iupac(F.col("sequence")).alias("valid"))


@query("select id, regexp_replace(upper(sequence), '[- ]', '', 'g') as sequence, length(sequence) - length(regexp_replace(sequence, '[- ]', '', 'g')) as n_gaps from ref_db")
def degap(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("sequence")
    return table(spark, d, "ref_db").select("id", dna.degap(s).alias("sequence"), (F.length(s) - F.length(F.regexp_replace(s, "[- ]", ""))).cast("bigint").alias("n_gaps"))


_EXPAND = " union all ".join(f"select '{k}' as l, '{b}' as b" for k, v in dna.IUPAC_BASES.items() for b in v)


@query(
    f"""with recursive letters as ({_EXPAND}),
sides as (select fwd_id as id, upper(replace(fwd_seq, ' ', '')) as s from primers where fwd_seq is not null union all select rev_id, upper(replace(rev_seq, ' ', '')) from primers where rev_seq is not null),
grow as (select id, s, 1 as k, '' as done from sides union all
  select g.id, g.s, g.k + 1, g.done || coalesce(l.b, substr(g.s, g.k, 1)) from grow g left join letters l on l.l = substr(g.s, g.k, 1) where g.k <= length(g.s))
select id, done as sequence from grow where k = length(s) + 1"""
)
def iupac_expand(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "primers")
    sides = p.select(F.col("fwd_id").alias("id"), F.col("fwd_seq").alias("s")).unionByName(p.select(F.col("rev_id").alias("id"), F.col("rev_seq").alias("s"))).where("s is not null")
    return sides.select("id", F.explode(dna.expand_iupac(F.replace("s", F.lit(" "), F.lit("")))).alias("sequence"))


@query(
    f"""with {_READS} select id, list_sum(q)::bigint as total, list_max(q)::bigint as best, list_min(q)::bigint as worst, round(list_avg(q) + 1e-9, 6) as mean from
  (select id, list_transform(regexp_extract_all(quality, '(?s).'), lambda c: ascii(c) - 33) as q from reads where length(quality) > 0)"""
)
def phred_decode(spark: SparkSession, d: str) -> DataFrame:
    q = reads(spark, d).where("length(quality) > 0").select("id", dna.phred(F.col("quality")).alias("q"))
    total = F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return q.select("id", total.alias("total"), F.array_max("q").cast("bigint").alias("best"), F.array_min("q").cast("bigint").alias("worst"), r6(total / F.size("q")).alias("mean"))


@query("select id, case when rtrim(sequence, '-') = '' then -1 else length(sequence) - length(ltrim(sequence, '-')) end as first_base, case when rtrim(sequence, '-') = '' then -1 else length(rtrim(sequence, '-')) end as last_base from pseudo_ref where sequence is not null")
def endgap(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "pseudo_ref").where("sequence is not null").select("id", dna.endgap(F.col("sequence")).alias("g"))
    return g.select("id", F.col("g.start").cast("bigint").alias("first_base"), F.col("g.stop").cast("bigint").alias("last_base"))


@query(
    f"""with {_HITS}, ops as (select hit_id, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHPX=])', 1))::bigint as n, unnest(regexp_extract_all(cigar, '(\\d+)([MIDNSHPX=])', 2)) as op from hits where cigar is not null)
select hit_id, op, count(*) as n_ops, sum(n)::bigint as letters from ops group by hit_id, op"""
)
def cigar_decode(spark: SparkSession, d: str) -> DataFrame:
    ops = hits(spark, d).where("cigar is not null").select("hit_id", F.explode(dna.cigar_ops(F.col("cigar"))).alias("x"))
    return ops.groupBy("hit_id", F.col("x.op").alias("op")).agg(F.count(F.lit(1)).alias("n_ops"), F.sum("x.len").alias("letters"))


@query(
    f"""with {_HITS} select hit_id,
  coalesce(list_sum(regexp_extract_all(cigar, '(\\d+)[MX=]', 1)::bigint[]), 0)::bigint as aligned,
  coalesce(list_sum(regexp_extract_all(cigar, '(\\d+)I', 1)::bigint[]), 0)::bigint as inserted, coalesce(list_sum(regexp_extract_all(cigar, '(\\d+)D', 1)::bigint[]), 0)::bigint as deleted,
  coalesce(nullif(regexp_extract(cigar, '^(?:\\d+D)?(\\d+)[IS]', 1), '')::int, 0) as q_head, coalesce(nullif(regexp_extract(cigar, '(\\d+)[IS](?:\\d+D)?$', 1), '')::int, 0) as q_tail
  from hits where cigar is not null"""
)
def cigar_stats(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("cigar")
    rows = hits(spark, d).where("cigar is not null").withColumn("o", dna.cigar_offsets(c))
    return rows.select("hit_id", dna.cigar_total(c, "MX=").alias("aligned"), dna.cigar_total(c, "I").alias("inserted"), dna.cigar_total(c, "D").alias("deleted"), F.col("o.q_start").alias("q_head"), F.col("o.q_tail").alias("q_tail"))


@query(
    f"""with {_HITS}, {_READS}, parts as (select h.hit_id, h.orientation, substr(r.sequence, h.q_start + 1, h.q_end - h.q_start) as s, substr(r.quality, h.q_start + 1, h.q_end - h.q_start) as q
  from hits h join reads r on r.id = h.query_id where h.q_end > h.q_start and h.q_start >= 0)
select hit_id, case when orientation = '-' then reverse(translate(upper(s), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) else s end as sequence, case when orientation = '-' then reverse(q) else q end as quality from parts"""
)
def slice_strand(spark: SparkSession, d: str) -> DataFrame:
    h = hits(spark, d).where("q_end > q_start and q_start >= 0").select("hit_id", "query_id", "q_start", "q_end", "orientation")
    j = h.join(reads(spark, d).select(F.col("id").alias("query_id"), "sequence", "quality"), "query_id")
    a = [F.col("q_start"), F.col("q_end"), F.col("orientation")]
    return j.select("hit_id", dna.slice_strand(F.col("sequence"), *a).alias("sequence"), dna.slice_quality(F.col("quality"), *a).alias("quality"))


# --- reads: header, filters, totals ------------------------------------------------------------------------------------


@query(
    """select id, loaded_at, coalesce(nullif(regexp_extract(header, '(?:^| )read=(\\d+)', 1), '')::int, -1) as read_no, coalesce(nullif(regexp_extract(header, '(?:^| )ch=(\\d+)', 1), '')::int, -1) as ch,
  nullif(regexp_extract(header, '(?:^| )runid=(\\S+)', 1), '') as run_id, regexp_extract(header, '^@?(\\S*)', 1) as header_id from ont_reads where header is not null"""
)
def read_header_parse(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.sources.fastq import header_fields

    rows = table(spark, d, "ont_reads").where("header is not null")
    f = header_fields(F.col("header"))
    return rows.select("id", "loaded_at", f["read_no"].alias("read_no"), f["ch"].alias("ch"), f["run_id"].alias("run_id"), f["id"].alias("header_id"))


@query(f"with {_READS} select id, length(sequence) as n from reads where (length(sequence) > 500 and length(sequence) < 1200) or (length(sequence) > 2000 and length(sequence) < 3000)")
def length_filter_ranges(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("sequence")
    return reads(spark, d).where(dna.in_size_ranges(n, dna.size_ranges("500-1200,2000-3000"))).select("id", n.cast("bigint").alias("n"))


@query(f"with {_READS}, {_HITS} select id from reads where not exists (select 1 from hits where query_id = id and database_id like 'HAP%')")
def exclude_anti(spark: SparkSession, d: str) -> DataFrame:
    """Reads without a hit on any of the main haplotypes."""
    return tables.exclude(reads(spark, d), hits(spark, d).where(F.col("database_id").startswith("HAP"))).select("id")


@query("select distinct query_id as id from alignments where query_id is not null intersect select id from pseudo_ref")
def id_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo references that were aligned to something."""
    return table(spark, d, "alignments").where("query_id is not null").select(F.col("query_id").alias("id")).intersect(table(spark, d, "pseudo_ref").select("id"))


@query(f"with {_HITS} select hit_id from hits where database_id not like 'HAP%' and contains(query_id, '_frag') and q_len > 0")
def id_filters(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where(~F.col("database_id").startswith("HAP") & F.col("query_id").contains("_frag") & (F.col("q_len") > 0)).select("hit_id")


@query(
    f"""with {_HITS}, pr as (select distinct id from pseudo_ref where id is not null), best as (select *, row_number() over (partition by query_id order by as_score desc nulls last, hit_id) as r from hits where database_id like 'HAP%'),
own as (select *, row_number() over (partition by query_id order by as_score desc nulls last, hit_id) as r from hits where database_id in (select upper(trim(id)) from pr) and database_id <> upper(trim(query_id)))
select pr.id, a.database_id as ref_id, round(a.similarity + 1e-9, 6) as ref_match, b.database_id as clst_id, round(b.similarity + 1e-9, 6) as clst_match
from pr left join best a on a.query_id = pr.id and a.r = 1 left join own b on b.query_id = pr.id and b.r = 1"""
)
def match_haplotypes(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo references with their best main haplotype and their best other pseudo reference."""
    from loomseq.plans import pipeline

    ids = table(spark, d, "pseudo_ref").where("id is not null")
    h = hits(spark, d)
    own = h.join(ids.select(F.upper(F.trim("id")).alias("database_id")).distinct(), "database_id", "left_semi").where(F.col("database_id") != F.upper(F.trim("query_id")))
    m = pipeline.match_haplotypes(ids, h.where(F.col("database_id").startswith("HAP")), own)
    return m.withColumns({c: r6(c) for c in ("ref_match", "clst_match")})


@query(f"with {_HITS} select query_id as qname, case when orientation = '-' then 16 else 0 end as flag, case when orientation = '-' then '-' else '+' end as orientation, database_id as rname, t_start + 1 as pos, mapq, coalesce(cigar, '*') as cigar, coalesce(as_score, 0) as as_score, coalesce(nm, 0) as nm, hit_id from hits")
def sam_shape(spark: SparkSession, d: str) -> DataFrame:
    """All hits as SAM records, the strand read back from the flag."""
    from loomseq.operators.align import to_sam

    return to_sam(hits(spark, d)).withColumn("orientation", F.when(dna.is_reverse(F.col("flag")), "-").otherwise("+"))


@query(
    """select id, sequence, list_aggregate(list_transform(range(1, length(sequence) + 1), lambda k: case when substr(sequence, k, 1) = '-' then '"'
    else substr(quality, k - length(substr(sequence, 1, k)) + length(replace(substr(sequence, 1, k), '-', '')), 1) end), 'string_agg', '') as quality from pseudo_ref where length(sequence) > 0 and quality is not null"""
)
def phred_gap(spark: SparkSession, d: str) -> DataFrame:
    """Quality strings of pseudo references stretched to their gaps."""
    t = table(spark, d, "pseudo_ref").where("length(sequence) > 0 and quality is not null")
    return t.select("id", "sequence", dna.phred_gap(F.col("sequence"), F.col("quality")).alias("quality"))


@query(
    f"""with {_HITS}, {_READS}, refs as (select upper(trim(id)) as id, sequence from ref_db), parts as (
  select h.hit_id, h.cigar, case when h.orientation = '-' then reverse(translate(upper(substr(r.sequence, h.q_start + 1, h.q_end - h.q_start)), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) else substr(r.sequence, h.q_start + 1, h.q_end - h.q_start) end as q, substr(t.sequence, h.t_start + 1) as t
  from hits h join reads r on r.id = h.query_id join refs t on t.id = h.database_id where h.cigar is not null and h.q_end > h.q_start and h.q_start >= 0 and r.sequence is not null and t.sequence is not null),
ops as (select hit_id, q, t, unnest(regexp_extract_all(cigar, '(\\d+)([MIDSX=])', 1))::int as n, unnest(regexp_extract_all(cigar, '(\\d+)([MIDSX=])', 2)) as op, generate_subscripts(regexp_extract_all(cigar, '(\\d+)([MIDSX=])', 1), 1) as k from parts),
places as (select *, coalesce(sum(case when op <> 'D' then n end) over (partition by hit_id order by k rows between unbounded preceding and 1 preceding), 0)::int as i,
  coalesce(sum(case when op <> 'I' then n end) over (partition by hit_id order by k rows between unbounded preceding and 1 preceding), 0)::int as j from ops)
select hit_id, string_agg(case when op = 'S' then lower(substr(q, i + 1, n)) when op = 'D' then repeat('-', n) else substr(q, i + 1, n) end, '' order by k) as query,
  string_agg(case when op = 'I' then repeat('-', n) else substr(t, j + 1, n) end, '' order by k) as target, string_agg(repeat(case when op in ('M', '=') then '|' else ' ' end, n), '' order by k) as ticks from places group by hit_id"""
)
def cigar_align(spark: SparkSession, d: str) -> DataFrame:
    """Hits of reads on the truth database written out with their gaps."""
    h = hits(spark, d).where("cigar is not null and q_end > q_start and q_start >= 0").select("hit_id", "query_id", "database_id", "orientation", "q_start", "q_end", "t_start", "cigar")
    refs = table(spark, d, "ref_db").where("sequence is not null").select(F.upper(F.trim("id")).alias("database_id"), F.col("sequence").alias("_t"))
    j = h.join(reads(spark, d).select(F.col("id").alias("query_id"), "sequence"), "query_id").join(refs, "database_id")
    q = dna.slice_strand(F.col("sequence"), F.col("q_start"), F.col("q_end"), F.col("orientation"))
    a = dna.cigar_align(q, F.expr("substring(_t, t_start + 1)"), F.col("cigar"))
    return j.select("hit_id", a.alias("a")).select("hit_id", "a.query", "a.target", "a.ticks")


@query(f"with {_READS}, {_HITS} select id, length(sequence)::bigint as n, exists (select 1 from hits where query_id = id) as mapped from reads")
def annotate_unmapped(spark: SparkSession, d: str) -> DataFrame:
    seen = hits(spark, d).select(F.col("query_id").alias("id"), F.lit(True).alias("m")).distinct()
    return reads(spark, d).join(seen, "id", "left").select("id", F.length("sequence").cast("bigint").alias("n"), F.coalesce("m", F.lit(False)).alias("mapped"))


@query(
    f"""with {_READS}, {_HITS}, m as (select id, length(sequence) as n, exists (select 1 from hits where query_id = id) as mapped from reads)
select count(*) as n_reads, round(sum(n) / 1e9, 9) as gb, count(*) filter (where not mapped) as n_unmapped, round(coalesce(sum(n) filter (where not mapped), 0) / 1e9, 9) as gb_unmapped from m"""
)
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    m = annotate_unmapped(spark, d)
    free = ~F.col("mapped")
    return m.agg(F.count(F.lit(1)).alias("n_reads"), F.round(F.sum("n") / 1e9, 9).alias("gb"), F.count(F.when(free, 1)).alias("n_unmapped"), F.round(F.coalesce(F.sum(F.when(free, F.col("n"))), F.lit(0)) / 1e9, 9).alias("gb_unmapped"))


@query(f"with {_READS} select (floor(length(sequence) / 100) * 100)::int as bin, count(*) as n, round(sum(length(sequence)) / 1e6 + 1e-9, 6) as mb from reads where length(sequence) < 50000 group by 1")
def length_hist(spark: SparkSession, d: str) -> DataFrame:
    return stats.length_histogram(reads(spark, d), F.length("sequence")).withColumn("mb", r6("mb"))


@query(f"with {_READS} select id, round((epoch_us(start_time) - min(epoch_us(start_time)) over ()) / 3.6e9 + 1e-9, 6) as hours from reads where start_time is not null")
def elapsed_hours(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).where("start_time is not null").select("id", F.unix_micros(F.col("start_time").cast("timestamp")).alias("t"))
    first = r.agg(F.min("t")).first()[0]  # one number; a window without partitions would bring all reads to one task
    return r.select("id", r6((F.col("t") - F.lit(first)) / 3.6e9).alias("hours"))


@query(f"with {_READS} select run_id, quantile_cont(length(sequence), 0.1) as p10, quantile_cont(length(sequence), 0.25) as p25, quantile_cont(length(sequence), 0.5) as p50, quantile_cont(length(sequence), 0.75) as p75, quantile_cont(length(sequence), 0.9) as p90, count(*) as n from reads group by run_id")
def group_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return stats.group_percentiles(reads(spark, d).withColumn("n_bases", F.length("sequence")), "run_id", "n_bases")


@query(f"with {_READS}, {_HITS}, w as (select distinct coalesce(run_id, '-') as run_id from reads) select w.run_id, coalesce(x.n, 0) as n, coalesce(x.channels, -1) as channels from w left join (select coalesce(run_id, '-') as run_id, count(ch) as n, count(distinct ch) as channels from reads where length(sequence) > 3000 group by 1) x on x.run_id = w.run_id")
def group_values(spark: SparkSession, d: str) -> DataFrame:
    r = reads(spark, d).withColumn("run_id", F.coalesce("run_id", F.lit("-")))
    got = stats.group_values(r.where("length(sequence) > 3000"), "run_id", "ch", r)
    return got.select("run_id", "n", F.when(F.col("n") == 0, F.lit(-1)).otherwise(F.size("values")).cast("bigint").alias("channels"))


# --- hits: scores, best hits, islands ----------------------------------------------------------------------------------


@query(f"with {_HITS} select hit_id, round(similarity + 1e-9, 6) as similarity, round(n_match / nullif(tot, 0)::double + 1e-9, 6) as match_score from hits")
def similarity_score(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).select("hit_id", r6("similarity").alias("similarity"), r6(F.col("n_match") / F.nullif("tot", F.lit(0))).alias("match_score"))


@query(f"with {_HITS} select hit_id from hits where n_match / nullif(tot, 0)::double > 0.9 and q_end - q_start > 10 and tot > 0")
def score_filter(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where("n_match / nullif(tot, 0) > 0.9 and q_end - q_start > 10 and tot > 0").select("hit_id")


_BEST = "select {k}, hit_id, similarity from (select *, row_number() over (partition by {k} order by as_score desc nulls last, hit_id) as r from hits) where r = 1"


@query(f"with {_HITS}, b as ({_BEST.format(k='query_id')}) select query_id, hit_id, round(similarity + 1e-9, 6) as similarity from b")
def best_hit(spark: SparkSession, d: str) -> DataFrame:
    return H.best_hits(hits(spark, d), ["query_id"]).select("query_id", "hit_id", r6("similarity").alias("similarity"))


@query(f"with {_HITS} select query_id, database_id, hit_id, as_score is not null as scored from (select *, row_number() over (partition by query_id, database_id order by as_score desc nulls last, hit_id) as r from hits) where r = 1")
def best_hit_pair(spark: SparkSession, d: str) -> DataFrame:
    return H.best_hits(hits(spark, d), ["query_id", "database_id"]).select("query_id", "database_id", "hit_id", F.col("as_score").isNotNull().alias("scored"))


@query(f"with {_HITS} select query_id, hit_id, row_number() over (partition by query_id order by as_score asc nulls first, hit_id) - 1 as rank from hits")
def rank_hits(spark: SparkSession, d: str) -> DataFrame:
    return H.rank_hits(hits(spark, d)).select("query_id", "hit_id", F.col("rank").cast("bigint").alias("rank"))


@query(f"with {_HITS}, {_ISLANDS.format(t=0)} select hit_id, cluster_num, cluster_item_count from counted")
def islands(spark: SparkSession, d: str) -> DataFrame:
    return intervals.islands(hits(spark, d).select("hit_id", "query_id", "q_start", "q_end")).select("hit_id", "cluster_num", "cluster_item_count")


@query(f"with {_HITS}, {_ISLANDS.format(t=50)} select query_id, count(distinct cluster_num) as n_islands, max(cluster_item_count) as largest from counted group by query_id")
def island_counts(spark: SparkSession, d: str) -> DataFrame:
    i = intervals.islands(hits(spark, d).select("hit_id", "query_id", "q_start", "q_end"), thresh=50)
    return i.groupBy("query_id").agg(F.max("cluster_num").alias("n_islands"), F.max("cluster_item_count").alias("largest"))


@query(f"with {_HITS}, {_RESOLVED.format(t=50)} select hit_id from resolved")
def overlap_resolve(spark: SparkSession, d: str) -> DataFrame:
    return intervals.remove_overlaps(hits(spark, d).select("hit_id", "query_id", "q_start", "q_end", "as_score"), "as_score", thresh=50).select("hit_id")


@query(f"with {_HITS}, {_RESOLVED.format(t=20)} select query_id, database_id, hit_id, round(similarity + 1e-9, 6) as similarity, count(*) over (partition by query_id) > 1 as chimeric from resolved")
def accuracy_islands(spark: SparkSession, d: str) -> DataFrame:
    """The accuracy report of given hits: non-overlapping hits of each read, several of them mark a chimera."""
    rows = intervals.remove_overlaps(hits(spark, d).select("hit_id", "query_id", "database_id", "q_start", "q_end", "as_score", "similarity"), "as_score", thresh=20)
    return H.flag_chimeras(rows).select("query_id", "database_id", "hit_id", r6("similarity").alias("similarity"), "chimeric")


@query(
    f"""with {_HITS}, {_RESOLVED.format(t=50)}, t as (select *, lag(orientation) over (partition by query_id order by q_start, hit_id) as prev from resolved)
select query_id, count(*) as n_frags, count(*) filter (where prev <> orientation) as n_inversions, max(q_len) as q_len, (max(q_len) - sum(q_end - q_start))::bigint as q_unmapped,
  sum(t_start)::bigint as db_fwd_cover, sum(t_len - t_end)::bigint as db_rev_cover, sum(t_end - t_start)::bigint as match_size, round(avg(match_score) + 1e-9, 6) as avg_match, round(avg(as_score) + 1e-9, 6) as avg_as, round(stddev_pop(as_score) + 1e-9, 6) as std_as
from t group by query_id"""
)
def annotate_reads(spark: SparkSession, d: str) -> DataFrame:
    a = H.annotate_reads(intervals.remove_overlaps(hits(spark, d), "as_score", thresh=50))
    return a.withColumns({c: r6(c) for c in ("avg_match", "avg_as", "std_as")})


_BOUNDS = """nb as (select *, row_number() over w - 1 as frag_no, case when lag(orientation) over w = orientation then lag(q_end) over w end as p_end, case when lead(orientation) over w = orientation then lead(q_start) over w end as n_start
  from resolved window w as (partition by query_id order by q_start, hit_id)),
bounds as (select hit_id, query_id, frag_no, (case when p_end is null then q_start when (q_start - p_end) * 4 < q_end - q_start then floor((q_start + p_end) / 2.0) else greatest(q_start - 5, 0) end)::int as s1,
  (case when n_start is null then q_end when (n_start - q_end) * 4 < q_end - q_start then floor((q_end + n_start) / 2.0) else least(q_end + 5, q_len) end)::int as s2 from nb)"""


@query(f"with {_HITS}, {_RESOLVED.format(t=50)}, {_BOUNDS} select hit_id, query_id, frag_no, s1, s2, s2 - s1 > 10 as kept from bounds")
def frag_boundaries(spark: SparkSession, d: str) -> DataFrame:
    b = intervals.fragment_bounds(intervals.remove_overlaps(hits(spark, d), "as_score", thresh=50), 4, 5)
    return b.select("hit_id", "query_id", F.col("frag_no").cast("bigint").alias("frag_no"), F.col("s1"), F.col("s2"), (F.col("s2") - F.col("s1") > 10).alias("kept"))


_PAIRS = """prim as (select *, case when hit_id % 2 = 0 then 'fwd' else 'rev' end as pdir from hits where as_score is not null),
o as (select *, lead(pdir) over w as np, lead(orientation) over w as no, lead(as_score) over w as nsc, lead(hit_id) over w as nh, lead(q_start) over w as ns, lead(q_end) over w as ne, lag(pdir) over w as pp, lag(orientation) over w as po
  from prim window w as (partition by query_id order by q_start, hit_id)),
s as (select *, coalesce(orientation = '+' and no = '-' and np <> pdir, false) as pair from o where not coalesce(orientation = '-' and po = '+' and pp <> pdir, false)),
best as (select *, as_score + case when pair then nsc else 0 end as score from s qualify row_number() over (partition by query_id order by score desc, q_start, hit_id) = 1)"""


@query(
    f"""with {_HITS}, {_PAIRS} select query_id as id, coalesce(case when pdir = 'fwd' then q_start when pair then ns end, -1) as fwd_q_start, case when pdir = 'fwd' then orientation when pair then no end as fwd_orientation,
  coalesce(case when pdir = 'rev' then q_end when pair then ne end, -1) as rev_q_end, case when pdir = 'rev' then orientation when pair then no end as rev_orientation, pair as both_sides from best"""
)
def primer_pairing(spark: SparkSession, d: str) -> DataFrame:
    """The pairing rule over all scored hits, with the direction taken from the hit's number."""
    p = hits(spark, d).where("as_score is not null").withColumn("pdir", F.when(F.col("hit_id") % 2 == 0, "fwd").otherwise("rev"))
    return H.primer_pairs(p).select("id", F.coalesce("fwd_q_start", F.lit(-1)).alias("fwd_q_start"), "fwd_orientation", F.coalesce("rev_q_end", F.lit(-1)).alias("rev_q_end"), "rev_orientation", (F.col("fwd_primer").isNotNull() & F.col("rev_primer").isNotNull()).alias("both_sides"))


@query(
    f"""with {_HITS}, {_PAIRS} select query_id as id, case when pdir = 'fwd' then q_start else ns end as fwd_start, coalesce(pdir = 'fwd', false) as plus,
  case when pdir = 'fwd' then q_start else q_start end as start, ne as stop from best where pair"""
)
def primer_slices(spark: SparkSession, d: str) -> DataFrame:
    p = hits(spark, d).where("as_score is not null").withColumn("pdir", F.when(F.col("hit_id") % 2 == 0, "fwd").otherwise("rev"))
    return H.primer_slice_bounds(H.primer_pairs(p)).select("id", F.col("fwd_q_start").alias("fwd_start"), (F.col("fwd_orientation") == "+").alias("plus"), "start", "stop")


@query(
    f"""with {_HITS}, {_PAIRS}, m as (select b.query_id as id, 1 - (b.n_match + n.n_match) / (b.tot + n.tot)::double as e from best b join hits n on n.hit_id = b.nh where b.pair) select id, round(e + 1e-9, 6) as primer_error from m"""
)
def primer_error(spark: SparkSession, d: str) -> DataFrame:
    p = hits(spark, d).where("as_score is not null").withColumn("pdir", F.when(F.col("hit_id") % 2 == 0, "fwd").otherwise("rev"))
    both = H.primer_pairs(p).where("fwd_primer is not null and rev_primer is not null")
    return both.select("id", r6(dna.primer_error(*[F.col(c) for c in ("fwd_n_match", "fwd_tot", "rev_n_match", "rev_tot")])).alias("primer_error"))


@query(
    f"""with {_HITS}, {_READS}, {_PAIRS}, m as (select query_id as id, case when pdir = 'fwd' then q_start when pair then ns end as fs, case when pdir = 'fwd' then q_end when pair then ne end as fe, case when pdir = 'fwd' then orientation when pair then no end as fo,
    case when pdir = 'rev' then q_start when pair then ns end as rs, case when pdir = 'rev' then q_end when pair then ne end as re, case when pdir = 'rev' then orientation when pair then no end as ro from best),
p as (select r.id, r.sequence, fs, fe, rs, re, length(r.sequence) as n, coalesce(fo, ro) = case when fo is not null then '+' else '-' end as plus from reads r join m on m.id = r.id),
b as (select *, case when plus then coalesce(fe, 0) else coalesce(re, 0) end as a, case when plus then coalesce(rs, n) else coalesce(fs, n) end as z from p),
c as (select id, plus, substr(sequence, fs + 1, greatest(fe - fs, 0)) as f, case when z > a then substr(sequence, a + 1, z - a) else '' end as s, substr(sequence, rs + 1, greatest(re - rs, 0)) as r from b)
select id, case when plus then f else reverse(translate(upper(f), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) end as fwd_primer_seq, case when plus then s else reverse(translate(upper(s), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) end as sequence,
  case when plus then r else reverse(translate(upper(r), 'ATGCRYKMBVDH', 'TACGYRMKVBHD')) end as rev_primer_seq from c where length(s) > 10"""
)
def trim_fixed(spark: SparkSession, d: str) -> DataFrame:
    """The trimming rule over all reads, with pairs of given hits in place of primers."""
    from loomseq.plans import pipeline

    p = hits(spark, d).where("as_score is not null").withColumn("pdir", F.when(F.col("hit_id") % 2 == 0, "fwd").otherwise("rev"))
    return pipeline.trim(H.primer_pairs(p), reads(spark, d).select("id", "sequence")).select("id", "fwd_primer_seq", "sequence", "rev_primer_seq")


@query(f"with {_HITS} select hit_id, round(s1 / (s1 + max(s1) over (partition by query_id))::double + 1e-9, 6) as weight from hits where s1 > 0")
def hit_weight(spark: SparkSession, d: str) -> DataFrame:
    return H.hit_weights(hits(spark, d).where("s1 > 0")).select("hit_id", r6("weight").alias("weight"))


@query(f"with {_HITS} select hit_id, round(s1 / (max(s1) over (partition by database_id))::double + 1e-9, 6) as relative from hits where s1 > 0")
def sweep_norm(spark: SparkSession, d: str) -> DataFrame:
    return H.relative_to_target(hits(spark, d).where("s1 > 0")).select("hit_id", r6("relative").alias("relative"))


@query(f"with {_HITS} select database_id, hit_id from hits qualify row_number() over (partition by database_id order by similarity desc, hit_id) <= 20")
def top_csize(spark: SparkSession, d: str) -> DataFrame:
    return H.first_members(hits(spark, d), "database_id", [F.desc("similarity"), F.col("hit_id")], 20).select("database_id", "hit_id")


@query(f"with {_HITS} select (select count(distinct id) from pseudo_ref)::bigint as total, count(distinct query_id) as matched, (select count(distinct id) from pseudo_ref)::bigint - count(distinct query_id) as unmatched from hits where query_id in (select id from pseudo_ref)")
def unmatched_count(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "pseudo_ref").select("id").distinct()
    m = ids.join(hits(spark, d).select(F.col("query_id").alias("id"), F.lit(1).alias("m")).distinct(), "id", "left")
    return m.agg(F.count("id").alias("total"), F.count("m").alias("matched"), (F.count("id") - F.count("m")).alias("unmatched"))


@query(f"with {_HITS} select h.database_id, count(*) as n_hits, round(avg(1 - h.similarity) + 1e-9, 6) as mean_error, round(median(1 - h.similarity) + 1e-9, 6) as median_error from hits h join ref_db r on upper(trim(r.id)) = h.database_id group by h.database_id")
def error_per_target(spark: SparkSession, d: str) -> DataFrame:
    ref = table(spark, d, "ref_db").select(F.upper(F.trim("id")).alias("database_id"))
    j = hits(spark, d).join(ref, "database_id")
    return j.groupBy("database_id").agg(F.count(F.lit(1)).alias("n_hits"), r6(F.avg(1 - F.col("similarity"))).alias("mean_error"), r6(F.percentile(1 - F.col("similarity"), F.lit(0.5))).alias("median_error"))


# --- tables of counts, sampling, overlap of key sets -------------------------------------------------------------------


@query("select o_orderpriority as priority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by 1 having count(*) filter (where o_orderstatus in ('F', 'O', 'P')) > 0")
def contingency(spark: SparkSession, d: str) -> DataFrame:
    return stats.contingency(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "priority"), "priority", "o_orderstatus", ["F", "O", "P"])


_HASH = "(((({k})::bigint % 1000003 + {s}) * 2654435761) % 4294967296) / 4294967296.0"


@query(f"with {_HITS} select database_id, hit_id from hits qualify row_number() over (partition by database_id order by {_HASH.format(k='hit_id', s=3)}, hit_id) <= 10")
def subsample_hash(spark: SparkSession, d: str) -> DataFrame:
    return stats.sample_per_group(hits(spark, d), "database_id", F.col("hit_id"), 10, 3, "hit_id").select("database_id", "hit_id")


@query(
    f"""with {_HITS}, w as (select *, s1 / (s1 + max(s1) over (partition by query_id))::double as weight from hits where s1 > 0)
select database_id, hit_id from w where weight >= 0.5 or {_HASH.format(k='hit_id', s=1)} < weight qualify row_number() over (partition by database_id order by as_score desc nulls last, hit_id) <= 100"""
)
def cluster_subsample(spark: SparkSession, d: str) -> DataFrame:
    w = H.hit_weights(hits(spark, d).where("s1 > 0"))
    return stats.sample_by_weight(w, "database_id", F.col("weight"), F.col("hit_id"), "as_score", 100).select("database_id", "hit_id")


@query(f"with {_HITS} select database_id, hit_id from hits where s1 > 0 qualify row_number() over (partition by database_id order by {_HASH.format(k='hit_id', s=0)}, hit_id) <= 100")
def cluster_subsample_rand(spark: SparkSession, d: str) -> DataFrame:
    w = H.hit_weights(hits(spark, d).where("s1 > 0"))
    return stats.sample_by_weight(w, "database_id", F.col("weight"), F.col("hit_id"), "as_score", 100, "rand").select("database_id", "hit_id")


@query(
    f"""with {_HITS}, w as (select *, s1 / (s1 + max(s1) over (partition by query_id))::double as weight from hits where s1 > 0)
select database_id, hit_id from w where weight >= 0.5 or {_HASH.format(k='hit_id', s=1)} < weight qualify row_number() over (partition by database_id order by {_HASH.format(k='hit_id', s=0)}, hit_id) <= 100"""
)
def cluster_subsample_semi(spark: SparkSession, d: str) -> DataFrame:
    w = H.hit_weights(hits(spark, d).where("s1 > 0"))
    return stats.sample_by_weight(w, "database_id", F.col("weight"), F.col("hit_id"), "as_score", 100, "semi").select("database_id", "hit_id")


@query("select o_orderstatus as status, sum(greatest(floor(o_totalprice / 50000), 0))::bigint as copies from orders where floor(o_totalprice / 50000) > 0 group by 1")
def weight_replicate(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.floor(F.col("o_totalprice") / 50000).alias("w"))
    return stats.replicate(rows, F.col("w")).groupBy("status").agg(F.count(F.lit(1)).alias("copies"))


@query(
    """with f as (select distinct l_suppkey as file, l_partkey as key from lineitem), n as (select file, count(*) as n from f group by file),
i as (select a.file as file1, b.file as file2, count(*) as intersection from f a join f b on a.key = b.key and a.file < b.file group by 1, 2)
select file1, x.n as len1, x.n - intersection as len1_only, file2, y.n as len2, y.n - intersection as len2_only, intersection from i join n x on x.file = file1 join n y on y.file = file2"""
)
def file_overlap(spark: SparkSession, d: str) -> DataFrame:
    return stats.key_overlap(table(spark, d, "lineitem"), "l_suppkey", "l_partkey")


# --- matrices ----------------------------------------------------------------------------------------------------------

_LONG = "long as (select query_id as row_id, database_id as col_id, max_by(as_score::double, hit_id) as value from hits where as_score is not null and query_id is not null and database_id is not null group by 1, 2)"


@query(f"with {_HITS}, {_LONG} select row_id, col_id, value from long")
def feature_pivot_long(spark: SparkSession, d: str) -> DataFrame:
    return matrix.feature_long(hits(spark, d).where("query_id is not null and database_id is not null"), "as_score")


_COLS = ["HAP01", "HAP02", "HAP03", "HAP04", "HAP05", "HAP06", "HAP07", "HAP08"]


@query(f"with {_HITS}, {_LONG} select row_id, {', '.join(f'''coalesce(max(value) filter (where col_id = '{c}'), 0) as {c}''' for c in _COLS)} from long where col_id in ({', '.join(repr(c) for c in _COLS)}) group by row_id")
def feature_pivot_wide(spark: SparkSession, d: str) -> DataFrame:
    return matrix.feature_wide(feature_pivot_long(spark, d), _COLS)


_SIMS = "sims as (select query_id as row_id, database_id as col_id, max_by(similarity, hit_id) as value from hits where similarity is not null and query_id is not null and database_id is not null group by 1, 2), both_ways as (select least(row_id, col_id) as a, greatest(row_id, col_id) as b, value from sims)"


def _sims(spark: SparkSession, d: str) -> DataFrame:
    return matrix.feature_long(hits(spark, d).where("query_id is not null and database_id is not null"), "similarity")


@query(f"with {_HITS}, {_SIMS}, m as (select a, b, coalesce(min(nullif(value, 0)), 0) as v from both_ways group by a, b) select a as row_id, b as col_id, round(v + 1e-9, 6) as value from m union all select b, a, round(v + 1e-9, 6) from m where a <> b")
def symmetric_min_nonzero(spark: SparkSession, d: str) -> DataFrame:
    return matrix.symmetric(_sims(spark, d)).withColumn("value", r6("value"))


@query(f"with {_HITS}, {_SIMS}, m as (select a, b, max(value) as v from both_ways group by a, b) select a as row_id, b as col_id, round(v + 1e-9, 6) as value from m union all select b, a, round(v + 1e-9, 6) from m where a <> b")
def symmetric_max(spark: SparkSession, d: str) -> DataFrame:
    return matrix.symmetric(_sims(spark, d), larger=True).withColumn("value", r6("value"))


@query(f"with {_HITS}, {_SIMS} select row_id, col_id, round(case when row_id = col_id then 0 else 1 - value end + 1e-9, 6) as value from sims")
def sim_to_dist(spark: SparkSession, d: str) -> DataFrame:
    return matrix.to_distance(_sims(spark, d)).withColumn("value", r6("value"))


@query(
    f"""with {_HITS}, long as (select query_id as row_id, database_id as col_id, max_by(as_score::double, hit_id) as value from hits h join ref_db r on upper(trim(r.id)) = h.database_id where as_score is not null and query_id is not null group by 1, 2),
n as (select col_id, sqrt(sum(value * value)) as norm from long where value <> 0 group by 1),
p as (select a.col_id as col_a, b.col_id as col_b, sum(a.value * b.value) as dot from long a join long b on a.row_id = b.row_id and a.col_id < b.col_id where a.value <> 0 and b.value <> 0 group by 1, 2)
select col_a, col_b, round(1 - least(1.0, dot / (x.norm * y.norm)) + 1e-9, 6) as value from p join n x on x.col_id = col_a join n y on y.col_id = col_b"""
)
def cosine_distance(spark: SparkSession, d: str) -> DataFrame:
    """Cosine distance between truth-database items by the scores of the reads they share."""
    ref = table(spark, d, "ref_db").select(F.upper(F.trim("id")).alias("database_id"))
    long = matrix.feature_long(hits(spark, d).where("query_id is not null").join(ref, "database_id", "left_semi"), "as_score")
    return matrix.cosine_columns(long).withColumn("value", r6("value"))


# --- alignment, consensus and the pipeline -----------------------------------------------------------------------------


@query()
def align_accuracy(spark: SparkSession, d: str) -> DataFrame:
    """All pseudo references against the truth database: non-overlapping hits and the chimera flag."""
    from loomseq.plans import pipeline

    found = pipeline.accuracy(table(spark, d, "pseudo_ref").select("id", "sequence"), table(spark, d, "ref_db"))
    return found.select("query_id", "database_id", "orientation", "q_start", "q_end", "t_start", "t_end", "nm", "as_score", r6("similarity").alias("similarity"), "chimeric")


@query()
def primer_matches(spark: SparkSession, d: str) -> DataFrame:
    """The best primer pair of every read."""
    from loomseq.plans import pipeline

    return pipeline.match_primers(table(spark, d, "primers"), reads(spark, d).select("id", "sequence"))


@query()
def pseudo_references(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.plans import pipeline

    return pipeline.pseudo_references(table(spark, d, "primers"), reads(spark, d).select("id", "sequence", "quality"))


@query()
def consensus_per_read(spark: SparkSession, d: str) -> DataFrame:
    """Reads to consensus: fragments by alignment to the truth database, one vote per read."""
    from loomseq.plans import pipeline

    return pipeline.read_consensus(reads(spark, d).select("id", "sequence", "quality"), table(spark, d, "ref_db"))


@query()
def trimmed_consensus(spark: SparkSession, d: str) -> DataFrame:
    """All stages from reads to trimmed consensus sequences, on the pseudo references of the reads themselves."""
    from loomseq.plans import pipeline

    return pipeline.run(reads(spark, d).select("id", "sequence", "quality"), table(spark, d, "primers"))["trmc"]


_SHARED = """words as (select distinct kind, id, substr(s, k, 12) as w from (select kind, id, s, unnest(range(1, length(s) - 10)) as k from (
  select 'q' as kind, id, upper(sequence) as s from pseudo_ref where id is not null union all select 't', id, upper(sequence) from ref_db where id is not null) where length(s) >= 12)),
shared as (select a.id as query_id, b.id as database_id, count(*) as n_shared from words a join words b on a.w = b.w where a.kind = 'q' and b.kind = 't' group by 1, 2 having count(*) >= 3)"""


@query(f"with {_SHARED} select query_id, database_id, n_shared from shared")
def kmer_join(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo references and truth-database items that share words of 12 letters."""
    from loomseq.operators.align import kmer_join as join

    return join(table(spark, d, "pseudo_ref"), table(spark, d, "ref_db"))


@query(f"with {_SHARED}, q as (select id, min(upper(sequence)) as s from pseudo_ref group by id), t as (select id, min(upper(sequence)) as s from ref_db group by id) select query_id, database_id, levenshtein(substr(q.s, 1, 60), substr(t.s, 1, 60)) as edits from shared join q on q.id = query_id join t on t.id = database_id")
def edit_distance_join(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.operators.align import edit_distance_join as join

    return join(table(spark, d, "pseudo_ref"), table(spark, d, "ref_db"))


@query()
def semi_global_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every primer fitted into every pseudo reference, on its better strand."""
    from loomseq.operators.align import fit_pairs
    from loomseq.plans import pipeline

    known = F.array(*[F.struct(F.lit(i).alias("database_id"), F.lit("".join(x.upper().split())).alias("target")) for i, _, x in pipeline.primer_list(table(spark, d, "primers"))])
    pairs = table(spark, d, "pseudo_ref").where("id is not null and length(sequence) > 0").groupBy(F.col("id").alias("query_id")).agg(F.min("sequence").alias("query")).withColumn("p", F.explode(known))
    return fit_pairs(pairs.select("query_id", "query", "p.database_id", "p.target")).withColumn("similarity", r6("similarity"))


# --- clusters ----------------------------------------------------------------------------------------------------------


def _truth_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances between pseudo references by their given hits on each other."""
    ids = table(spark, d, "pseudo_ref").select(F.upper(F.trim("id")).alias("database_id")).distinct()
    inner = hits(spark, d).withColumn("query_id", F.upper(F.trim("query_id"))).join(ids, "database_id", "left_semi").join(ids.withColumnRenamed("database_id", "query_id"), "query_id", "left_semi")
    return matrix.to_distance(matrix.symmetric(matrix.feature_long(inner.where("query_id <> database_id"), "similarity")))


_DIST = f"""{_HITS}, pr as (select distinct upper(trim(id)) as id from pseudo_ref),
sims as (select upper(trim(query_id)) as r, database_id as c, max_by(similarity, hit_id) as v from hits where upper(trim(query_id)) in (select id from pr) and database_id in (select id from pr) and upper(trim(query_id)) <> database_id and similarity is not null group by 1, 2),
half as (select least(r, c) as a, greatest(r, c) as b, 1 - coalesce(min(nullif(v, 0)), 0) as value from sims group by 1, 2),
dist as (select a as row_id, b as col_id, value from half union all select b, a, value from half)"""


@query(
    f"""with recursive {_DIST}, e as (select row_id, col_id from dist where value <= 0.1), reach as (select distinct row_id as id, row_id as other from dist union select r.id, e.col_id from reach r join e on e.row_id = r.other),
g as (select id, min(other) as cluster_id, count(*) as size from reach group by id) select id, cluster_id, size from g"""
)
def single_linkage(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.operators.graph import single_linkage as linkage

    return linkage(_truth_distances(spark, d), 0.1)


@query(
    f"""with recursive {_DIST}, near as (select * from dist where value <= 0.15), cores as (select row_id as id from near group by row_id having count(*) + 1 >= 4),
e as (select row_id, col_id from near where row_id in (select id from cores) and col_id in (select id from cores)),
reach as (select id, id as other from cores union select r.id, e.col_id from reach r join e on e.row_id = r.other), g as (select id, min(other) as cluster_id from reach group by id),
border as (select n.col_id as id, min({{value: n.value, row_id: n.row_id, cluster_id: g.cluster_id}}).cluster_id as cluster_id from near n join g on g.id = n.row_id where n.col_id not in (select id from cores) group by n.col_id)
select i.id, coalesce(g.cluster_id, b.cluster_id) as cluster_id, g.id is not null as core from (select distinct row_id as id from dist) i left join g on g.id = i.id left join border b on b.id = i.id"""
)
def density_clusters(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.operators.graph import density_clusters as density

    return density(_truth_distances(spark, d), 0.15, 4)


@query()
def density_ordering(spark: SparkSession, d: str) -> DataFrame:
    """The density ordering inside every single-linkage cluster of the pseudo references."""
    from loomseq.operators.cluster import density_order

    dist = _truth_distances(spark, d)
    linked = single_linkage(spark, d).where("size > 2")
    long = dist.join(linked.select(F.col("id").alias("row_id"), "cluster_id"), "row_id").join(linked.select(F.col("id").alias("col_id"), F.col("cluster_id").alias("_o")), "col_id").where("cluster_id = _o")
    return density_order(long.select(F.col("cluster_id").alias("linked"), "row_id", "col_id", "value"), "linked", 2, 0.2)


@query()
def kmeans_bins(spark: SparkSession, d: str) -> DataFrame:
    """Relative scores of all hits in three bins."""
    from loomseq.operators.cluster import kmeans_bins as bins

    rows = H.relative_to_target(hits(spark, d).where("s1 > 0")).select("hit_id", "relative")
    return bins(rows, "relative", 3, seed=1).select("hit_id", "bin")


@query()
def kmeans_embeddings(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.operators.cluster import kmeans

    return kmeans(table(spark, d, "embeddings"), "embedding", 8, seed=1).select("vec_id", "cluster_id", r6("inertia").alias("inertia"))


@query()
def pca_embeddings(spark: SparkSession, d: str) -> DataFrame:
    from loomseq.operators.cluster import pca

    return pca(table(spark, d, "embeddings"), "embedding", 2).select("vec_id", r6(F.col("components")[0]).alias("f_0"), r6(F.col("components")[1]).alias("f_1"))



@query()
def cluster_centres(spark: SparkSession, d: str) -> DataFrame:
    """Split, sweep and merge over the pseudo references: the centres that have hits."""
    from loomseq.operators.cluster import perform_cluster

    seqs = table(spark, d, "pseudo_ref").where("id is not null and sequence is not null").select("id", dna.degap(F.col("sequence")).alias("sequence"))
    return perform_cluster(seqs)
