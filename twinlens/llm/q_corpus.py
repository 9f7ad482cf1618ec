"""Queries of the operators over the whole corpus: phrases and the manifest."""

from pyspark.sql import functions as F

from twinlens.llm import merkle, phrases
from twinlens.llm.queries import query, table

ENCODED = " || ".join(f"coalesce(octet_length(encode({c}::varchar)) || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", "text"))
#: Levels that the SQL spells out: 16 ** 7 rows.
SQL_LEVELS = 7


def _levels(name: str, first: str) -> str:
    """CTEs of the nodes (t, i, d) of each level of the trees of ``first``, and of the siblings (t, i, sib) at it; ``t`` compares null-safe."""
    out = [f"{name}0 as ({first})"]
    for k in range(SQL_LEVELS):
        # a tree of one node is done: it is carried on as it is
        out.append(f"{name}{k}n as (select *, count(*) over (partition by t) as n from {name}{k})")
        out.append(f"{name}{k + 1} as (select t, i // 16 as i, case when any_value(n) = 1 then any_value(d) else sha256(string_agg(d, '' order by i)) end as d from {name}{k}n group by t, i // 16)")
        out.append(
            f"{name}{k}s as (select a.t, a.i, coalesce(string_agg(b.d, '' order by b.i) filter (b.i < a.i), '') as lo, coalesce(string_agg(b.d, '' order by b.i) filter (b.i > a.i), '') as hi, any_value(a.n) as n"
            f" from {name}{k}n a join {name}{k}n b on a.t = b.t and a.i // 16 = b.i // 16 group by a.t, a.i)"
        )
    return ",\n    ".join(out)


def _climb(name: str, tree: str, index: str) -> str:
    return "\n    ".join(f"join {name}{k}s as {name}{k}s on {name}{k}s.t = {tree} and {name}{k}s.i = {index} // {16**k}" for k in range(SQL_LEVELS))


def _steps() -> tuple[str, str]:
    """CTEs that fold a leaf up one level after the other, and the last one's name."""
    out, before = [], "paths"
    for name in ("s", "r"):
        for k in range(SQL_LEVELS):
            here = f"up_{name}{k}"
            out.append(f"{here} as (select * replace (case when {name}n{k} = 1 then up else sha256({name}lo{k} || up || {name}hi{k}) end as up) from {before})")
            before = here
    return ",\n    ".join(out), before


_UP, _LAST = _steps()
_PARTS = [(n, k) for n in ("s", "r") for k in range(SQL_LEVELS)]


def _manifest_sql() -> str:
    lower = ENCODED.replace("text::varchar", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    return f"""
    with recursive crc_step as (select range as v, range::bigint as c, 0 as k from range(256)
        union all select v, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from crc_step where k < 8),
    crc_table as (select list(c order by v) as crc from crc_step where k = 8),
    crcs as (select doc_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ord((doc_id::varchar)[i])::bigint)),
        lambda a, b: xor(a >> 8, crc[(xor(a, b) & 255) + 1])), 4294967295) as crc from documents, crc_table),
    marked as (select doc_id, case when source is null then '' else '=' || source end as t, sha256({ENCODED}) as leaf, sha256({lower}) as lower_leaf, c.crc % 5 = 0 as bad
        from documents join (select distinct * from crcs) c using (doc_id)),
    leaves as (select doc_id, t, leaf, case when bad then lower_leaf else leaf end as alleged, row_number() over (partition by t order by doc_id, leaf) - 1 as i from marked),
    {_levels('s', 'select t, i, leaf as d from leaves')},
    crowns as (select t as name, d, row_number() over (order by encode(t)) - 1 as i from s{SQL_LEVELS}),
    {_levels('r', "select '' as t, i, d from crowns")},
    paths as (select l.doc_id, l.leaf, l.alleged as up, c.d as subroot, r{SQL_LEVELS}.d as root, {', '.join(f'{n}{k}s.lo as {n}lo{k}, {n}{k}s.hi as {n}hi{k}, {n}{k}s.n as {n}n{k}' for n, k in _PARTS)}
        from leaves l join crowns c on c.name = l.t join r{SQL_LEVELS} on true
    {_climb('s', 'l.t', 'l.i')}
    {_climb('r', "''", 'c.i')}),
    {_UP}
    select doc_id, leaf, subroot, root, sha256({' || '.join(f'{n}lo{k} || {n}hi{k}' for n, k in _PARTS)}) as proof_sha256, up as folded_root, up = root as verified from {_LAST}
    """


@query("op13_merkle", sql=_manifest_sql())
def manifest(spark, sf):
    docs = table(spark, sf, "documents")
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    given = [F.translate("text", merkle.UPPER, merkle.LOWER) if c == "text" else F.col(c) for c in columns]
    return merkle.manifest(docs, columns, "source", "doc_id", tampered, given)


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _grams(k: int) -> str:
    return f"select lang, w[i:i + {k - 1}] as g, count(*) as f from seq, lateral (select unnest(range(1, len(w) - {k - 2})) as i) group by all"


def _cut(k: int, first: str, rest: str) -> str:
    return f"select p.lang, p.g, p.f as a, l.f as l, r.f as r, {k} as k, (1000000::hugeint * p.f * p.f) // (l.f::hugeint * r.f) as score from {{}} p join {first} l on l.lang = p.lang and l.g = p.g[:{k}] join {rest} r on r.lang = p.lang and r.g = p.g[{k + 1}:]"


@query(
    "op12_phrases",
    sql=rf"""
    with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWERED}, '[.,;:!?
-]')) as p from documents),
    seq as (select lang, list_filter(regexp_split_to_array(p, '[ 	]+'), lambda x: x <> '') as w from pieces),
    g1 as ({_grams(1)}), g2 as ({_grams(2)}), g3 as ({_grams(3)}),
    c2 as (select * from g2 where f >= 10), c3 as (select * from g3 where f >= 10),
    cuts as ({_cut(1, 'g1', 'g1').format('c2')} union all {_cut(1, 'g1', 'g2').format('c3')} union all {_cut(2, 'g2', 'g1').format('c3')}),
    best as (select lang, g, arg_min(struct_pack(a, l, r, score), (score, k)) as b from cuts group by 1, 2),
    parts as (select lang, g[1:2] as g, f from c3 union all select lang, g[2:3], f from c3),
    held as (select lang, g, max(f) as most from parts group by 1, 2),
    kept as (select best.lang, array_to_string(best.g, ' ') as phrase, b.a, b.l, b.r, b.score from best left join held on held.lang = best.lang and held.g = best.g where 100 * coalesce(most, 0) < 50 * b.a),
    ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from kept),
    totals as (select lang, sum(f) as n from g1 group by 1)
    select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score from ranked join totals using (lang) where rank <= 2000
    """,
)
def collocations(spark, sf):
    return phrases.collocations(table(spark, sf, "documents"), least=10, top=2000, inside=50)
