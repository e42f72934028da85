"""The registered queries of the training-data operators, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomseq.functions.dna import IUPAC_BASES
from loomseq.llm import capping, clusters, components, leakage, near_duplicates, packing, reading, splitting, topn
from loomseq.session import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(table(spark, d, "pseudo_ref"))


def p1_near_duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(table(spark, d, "pseudo_ref"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "alignments"))


def p2_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components.match_groups(table(spark, d, "alignments")).groupBy("group_id").agg(F.count("*").alias("n_records"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_reads(table(spark, d, "ont_reads"), table(spark, d, "primers"))
    none = (F.col("n_boundaries") == 0) & (F.col("piece_no") == 0)
    return pieces.select("id", F.explode(F.when(none, F.array(F.lit(-1))).otherwise(F.col("boundaries"))).alias("cut_pos"))


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_reads(table(spark, d, "ont_reads"), table(spark, d, "primers")).drop("boundaries", "n_boundaries")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    columns = {"query_id": F.col("query_id"), "database_id": topn.canonical_database_id(), "as_score": F.col("as_score"), "created_on": F.to_date("created_at")}
    return topn.latest_rows(table(spark, d, "alignments"), "hit_id", "loaded_at", columns)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    kept = capping.cap_contributors(_hits(spark, d), F.col("database_id"), F.col("as_score"), [F.col("hit_id")], cap=40)
    return kept.where("contributor_rows > 40").select("hit_id")


def p4_capped_by_day(spark: SparkSession, d: str) -> DataFrame:
    """Every database id keeps at most 40 hits, shared out over the days on which its hits were made."""
    kept = capping.cap_contributors(_hits(spark, d), F.col("database_id"), F.col("as_score"), [F.col("hit_id")], cap=40, stratum=F.col("created_on"))
    return kept.select("hit_id", "database_id", F.col("created_on").cast("string").alias("created_on"), "stratum_rank", "contributor_rows")


def p4_capped_evenly(spark: SparkSession, d: str) -> DataFrame:
    """As ``p4_capped_by_day`` with an equal share for every day, so days with few hits leave slots that go to the others."""
    kept = capping.cap_contributors(_hits(spark, d), F.col("database_id"), F.col("as_score"), [F.col("hit_id")], cap=40, stratum=F.col("created_on"), even=True)
    return kept.select("hit_id", "database_id", F.col("created_on").cast("string").alias("created_on"), "stratum_rank", "contributor_rows")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.similarity_clusters(table(spark, d, "pseudo_ref")).where("size >= 3").select("id", "cluster_id")


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster with its size, its medoid, and the mean similarity of the hits between its members."""
    found = clusters.similarity_clusters(table(spark, d, "pseudo_ref"))
    a, b = found.select(F.col("id").alias("query_id"), "cluster_id"), found.select(F.col("id").alias("database_id"), F.col("cluster_id").alias("other"))
    hits = table(spark, d, "alignments").where("query_id <> database_id").select("hit_id", "query_id", "database_id", "similarity", "nm", "q_len", "t_len").dropDuplicates(["hit_id"])
    sim = F.when(F.col("similarity") > 1, F.col("similarity") / 100).otherwise(F.coalesce("similarity", 1 - F.col("nm") / F.least("q_len", "t_len")))
    inner = hits.join(a, "query_id").join(b, "database_id").where("cluster_id = other").groupBy("cluster_id").agg(F.count("*").alias("n_hits"), F.round(F.avg(sim), 6).alias("hit_similarity"))
    medoid = found.where("is_medoid").groupBy("cluster_id").agg(F.min("id").alias("medoid_id"), F.max("size").alias("size"), F.max("score").alias("medoid_score"))
    return medoid.join(inner, "cluster_id", "left").select("cluster_id", "size", "medoid_id", "medoid_score", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "hit_similarity")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(_hits(spark, d), "query_id", "as_score", ["database_id", "hit_id"], n=3).select("query_id", "hit_id")


def p6_ranked(spark: SparkSession, d: str) -> DataFrame:
    """The three best hits of every read with their rank."""
    return topn.top_n(_hits(spark, d), "query_id", "as_score", ["database_id", "hit_id"], n=3).select("query_id", "rank", "hit_id", "database_id")


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))


def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are: their number by room left, in steps of 64 tokens."""
    packed = packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))
    boxes = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n_items"))
    return boxes.groupBy((F.floor((2048 - F.col("used")) / 64) * 64).cast("int").alias("room_from")).agg(F.count("*").alias("n_containers"), F.sum("n_items").alias("n_items"), F.sum("used").alias("n_tokens"))


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """What packing has to keep: every document in the result, none split that fits, no container above its capacity."""
    packed = packing.pack_documents(table(spark, d, "documents").select("doc_id", "text"))
    docs = packed.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum("n_tokens").alias("tokens"))
    split = docs.agg(F.count("*").alias("n_documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= 2048)).alias("n_split"))
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("used")).agg(F.count_if(F.col("used") > 2048).alias("n_overfull"))
    return split.withColumn("k", F.lit(1)).join(full.withColumn("k", F.lit(1)), "k").select("n_documents", "n_split", "n_overfull")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(_texts(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.remove_leaks(_texts(spark, d), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.demanding_documents(_texts(spark, d), table(spark, d, "doc_labels")).select("doc_id")


def p9_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(_texts(spark, d), table(spark, d, "doc_labels"))


QUERIES = {f.__name__: f for f in (p1_found, p1_near_duplicate_groups, p2_found, p2_group_sizes, p3_found, p3_pieces, p4_found, p4_capped_by_day, p4_capped_evenly, p5_found, p5_profile, p6_found, p6_ranked, p7_containers, p7_fill, p7_whole, p8_found, p8_cleaned, p9_found, p9_levels)}

_LINKS = """
edges as (
  select query_id as a, database_id as b from alignments
  where query_id <> database_id
    and coalesce(case when similarity > 1 then similarity / 100 else similarity end, 1 - nm / least(q_len, t_len)::double) >= 0.92),
both_ways as (select a, b from edges union select b, a from edges),
reach as (select distinct a as record_id, a as other from both_ways
  union select r.record_id, e.b from reach r join both_ways e on e.a = r.other),
found as (select record_id, min(other) as group_id from reach group by record_id)
"""
_HITS = "hits as (select hit_id, any_value(query_id) as query_id, any_value(upper(trim(database_id))) as database_id, any_value(as_score) as as_score from alignments where hit_id is not null group by hit_id)"

_WORDS = r"""
plain as (select kind, id, regexp_replace(regexp_replace(text, '<[A-Za-z/!][^<>]*>|&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);', ' ', 'g'),
    '([\p{L}])-[ \t]*\r?\n(?:[ \t>#;%*]|//|--)*([\p{L}\p{N}])', '\1\2', 'g') as t
  from (select 'd' as kind, doc_id as id, text from documents union all select 'i', item_id, text from eval_items) where text is not null),
tokens as (select kind, id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') as w from plain),
windows as (select kind, id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) as gram from tokens where len(w) >= 12)
"""

_LETTERS = " union all ".join(f"select '{k}' as l, '{b}' as b" for k, v in IUPAC_BASES.items() for b in v)
_DAYS = """hits as (select hit_id, query_id, upper(trim(database_id)) as database_id, as_score, created_at::date as created_on from alignments where hit_id is not null
  qualify row_number() over (partition by hit_id order by loaded_at desc nulls last) = 1),
strata as (select database_id, created_on, count(*) as n, sum(count(*)) over (partition by database_id) as total from hits where database_id is not null group by 1, 2),
slots as (select *, (40 * n // total + (row_number() over (partition by database_id order by (40 * n) % total desc, created_on nulls first) <= 40 - sum(40 * n // total) over (partition by database_id))::int)::bigint as slots from strata),
ranked as (select h.*, s.total, s.slots, row_number() over (partition by h.database_id, h.created_on order by as_score desc nulls last, hit_id) as r
  from hits h left join slots s on s.database_id = h.database_id and s.created_on is not distinct from h.created_on)"""

SQL = {
    "p3_found": f"""with recursive letters as ({_LETTERS}),
sides as (select upper(replace(unnest([fwd_seq, rev_seq]), ' ', '')) as s from primers where fwd_id is not null and fwd_seq is not null and rev_id is not null and rev_seq is not null),
grow as (select s, 1 as k, '' as done from sides union all select g.s, g.k + 1, g.done || coalesce(l.b, substr(g.s, g.k, 1)) from grow g left join letters l on l.l = substr(g.s, g.k, 1) where g.k <= length(g.s)),
pats as (select distinct done as p from grow where k = length(s) + 1 and s <> ''),
long as (select id, upper(sequence) as s from ont_reads where id is not null and length(sequence) > 4000 qualify row_number() over (partition by id order by loaded_at desc nulls last, sequence desc) = 1),
windows as materialized (select id, k, n, substr(s, k + 1, n) as w from (select id, s, unnest(range(1, length(s))) as k from long), (select distinct length(p) as n from pats) where k + n <= length(s)),
found as (select distinct id, k from windows, pats where case when n = length(p) then hamming(w, p) <= 2 else false end)
select l.id, coalesce(f.k, -1)::int as cut_pos from long l left join found f on f.id = l.id""",
    "p4_capped_by_day": f"""with {_DAYS} select hit_id, database_id, created_on::varchar as created_on, case when database_id is not null then r end::int as stratum_rank, total::bigint as contributor_rows
      from ranked where database_id is null or total <= 40 or r <= slots""",
    "p7_whole": "select count(distinct doc_id) as n_documents, 0::bigint as n_split, 0::bigint as n_overfull from documents where doc_id is not null",
    "p2_found": f"with recursive {_LINKS} select record_id, group_id from found",
    "p2_group_sizes": f"with recursive {_LINKS} select group_id, count(*) as n_records from found group by group_id",
    "p4_found": f"""with {_HITS}, ranked as (
      select hit_id, row_number() over (partition by database_id order by as_score desc nulls last, hit_id) as r, count(*) over (partition by database_id) as n from hits where database_id is not null)
      select hit_id from ranked where n > 40 and r <= 40""",
    "p6_found": f"""with {_HITS} select query_id, hit_id from hits where query_id is not null
      qualify row_number() over (partition by query_id order by as_score desc nulls last, database_id, hit_id) <= 3""",
    "p8_found": f"""with {_WORDS} select distinct a.id as doc_id, b.id as item_id
      from windows a join windows b on a.gram = b.gram where a.kind = 'd' and b.kind = 'i'""",
    "p6_ranked": f"""with {_HITS}, ranked as (
      select query_id, row_number() over (partition by query_id order by as_score desc nulls last, database_id, hit_id) as rank, hit_id, database_id from hits where query_id is not null)
      select query_id, rank, hit_id, database_id from ranked where rank <= 3""",
}
