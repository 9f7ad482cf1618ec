"""Queries of the operators that compare documents, or vectors, with each other."""

from pyspark.sql import functions as F

from twinlens.llm import ann, near_dup, simhash, suffix_dedup
from twinlens.llm.queries import query, table


@query(
    "op5_minhash",
    sql=r"""
    with w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
    s as (select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w),
    cls as (select min(doc_id) as head, list_sort(s) as s, len(s) as n from s where len(s) > 0 group by 2, 3),
    e as (select head, n, unnest(s) as x from cls),
    rare as (select x, count(*) as df from e group by 1),
    ranked as (select head, n, x, row_number() over (partition by head order by df, x) as r from e join rare using (x)),
    prefix as (select head, n, x from ranked where r <= n - ceil(0.8 * n) + 1),
    pairs as (select distinct a.head as a, b.head as b from prefix a join prefix b using (x) where a.head < b.head and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
    links as (select a, b from (select p.a, p.b, ca.n as na, cb.n as nb, len(list_intersect(ca.s, cb.s)) as c from pairs p join cls ca on ca.head = p.a join cls cb on cb.head = p.b) where 100 * c >= 80 * (na + nb - c)),
    linked as (select a, b from links union all select b, a from links),
    """
    + ",\n    ".join(
        ["g0 as (select head as h, head as g from cls)"]
        + [f"g{k} as (select n.h, min(p.g) as g from (select h, g from g{k - 1}) p join (select head as h, head as o from cls union all select a, b from linked) n on n.o = p.h group by n.h)" for k in range(1, 9)]
    )
    + """
    select s.doc_id, len(s.s) as n_shingles, coalesce(g.g, s.doc_id) as component_id, coalesce(g.g, s.doc_id) = s.doc_id as kept
    from s left join cls on cls.s = list_sort(s.s) left join g8 g on g.h = cls.head
    """,
)
def minhash(spark, sf):
    return near_dup.near_duplicates(table(spark, sf, "documents"), words=2, percent=80).drop("text_key")


@query("op10_ann")
def nearest(spark, sf):
    return ann.neighbours(table(spark, sf, "embeddings"), every=50, k=5)


@query("op7_suffix_array")
def suffix_array(spark, sf):
    out = suffix_dedup.dedup(table(spark, sf, "documents"), length=100)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op11_simhash")
def simhash_groups(spark, sf):
    return simhash.near_duplicates(table(spark, sf, "documents"), words=4, distance=4)
