"""Queries of the operators that are DataFrame operations alone."""

from pyspark.sql import functions as F

from twinlens.llm import pii
from twinlens.llm.decontamination import contamination
from twinlens.llm.line_dedup import dedup_lines
from twinlens.llm.queries import query, table

BLANK = "trim(translate(content, chr(9) || chr(13) || chr(12) || chr(11), '    ')) = ''"


@query(
    "op3_line_dedup",
    sql=f"""
    with parts as (select doc_id, string_split(text, chr(10)) as p from documents where text is not null),
    exploded as (select doc_id, unnest(p) as content, unnest(range(len(p))) as pos_ from parts),
    visible as (select doc_id, pos_, content, length(content) as chars from exploded where not ({BLANK})),
    sums as (select *, row_number() over (partition by doc_id order by pos_) - 1 as line,
                sum(chars) over (partition by doc_id order by pos_) as after_, sum(chars) over (partition by doc_id) as total from visible),
    fored as (select *, case when total - (after_ - chars) >= 40 then count(*) over (partition by doc_id order by after_ - chars range between current row and 39 following) end as fore,
                case when after_ >= 40 then count(*) over (partition by doc_id order by after_ range between 39 preceding and current row) end as back from sums),
    seqs as (select doc_id, list(content order by line) as s from sums group by doc_id),
    spans as (select doc_id, line, fore as m from fored where fore is not null union select doc_id, line - back + 1, back from fored where back is not null),
    runs as (select doc_id, line, m, list_slice(s, line + 1, line + m) as body from spans join seqs using (doc_id)),
    firsts as (select body, min((doc_id, line)) as f from runs group by body),
    later as (select doc_id, line, m from runs join firsts using (body) where f < (doc_id, line)),
    covered as (select distinct doc_id, unnest(range(line, line + m)) as line from later),
    gone as (select doc_id, list(pos_ order by pos_) as removed_at from covered join sums using (doc_id, line) group by doc_id)
    select d.doc_id, coalesce(v.n, 0) as n_lines, coalesce(len(removed_at), 0) as n_removed, coalesce(array_to_string(removed_at, ','), '') as removed_lines,
        sha256(coalesce(case when removed_at is null then d.text else coalesce(array_to_string(
            list_transform(list_filter(range(len(p)), lambda i: not list_contains(removed_at, i)), lambda i: p[i + 1]), chr(10)), '') end, '')) as kept_sha256
    from documents d left join parts using (doc_id)
    left join gone using (doc_id) left join (select doc_id, count(*) as n from visible group by 1) v using (doc_id)
    """,
)
def line_dedup(spark, sf):
    out = dedup_lines(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.array_join("removed_at", ",").alias("removed_lines"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


WORDS = r"list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"


@query(
    "op4_decontamination",
    sql=f"""
    with d as (select doc_id, {WORDS} as w from documents), b as (select item_id, {WORDS} as w from benchmark),
    bw as (select distinct item_id, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') as body, least(10, len(w)) as m
           from b, lateral (select unnest(range(1, len(w) - least(10, len(w)) + 2)) as s) where len(w) > 0),
    sizes as (select distinct m from bw),
    dw as (select doc_id, s, m, array_to_string(list_slice(w, s, s + m - 1), ' ') as body
           from d, sizes, lateral (select unnest(range(1, len(w) - m + 2)) as s) where len(w) >= m),
    hits as (select doc_id, item_id, s, m from dw join bw using (body, m)),
    covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(s, s + m)) as p from hits) group by 1),
    items as (select doc_id, count(*) as n_items, string_agg(i, ',' order by i) as ids from (select distinct doc_id, item_id::varchar as i from hits) group by 1)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
    from d left join covered using (doc_id) left join items using (doc_id)
    """,
)
def decontamination(spark, sf):
    out = contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"), window=10)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def _is(kind):
    return lambda x: x["kind"] == kind


@query("op9_pii")
def personal_data(spark, sf):
    out = pii.find(table(spark, sf, "documents")).withColumn("base", F.filter("spans", lambda x: x["base"]))
    counts = [F.size(F.filter("base", _is(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return out.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
