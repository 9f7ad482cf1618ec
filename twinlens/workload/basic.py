"""Projections, filters, sorts, sets and scalar functions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from twinlens.functions import columns as C
from twinlens.functions import numbers as N
from twinlens.functions import strings as S
from twinlens.functions.formats import interval_cell
from twinlens.operators import aggregates as A
from twinlens.operators import sets
from twinlens.workload.base import query, r, rs, table

# Projections


@query("prj_select", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def prj_select(spark, sf):
    df = table(spark, sf, "orders")
    return C.select_positions(df, (0, 1), (2, 4))


@query("prj_rename", "SELECT p_partkey AS PARTKEY, p_name AS NAME_, p_brand AS BRAND FROM part")
def prj_rename(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand")
    return C.rename_with(df, lambda c: c.removeprefix("p_").upper()).withColumnRenamed("NAME", "NAME_")


@query("prj_prefix", "SELECT l_orderkey, l_linenumber, l_extendedprice AS extended, l_discount AS discount FROM lineitem")
def prj_prefix(spark, sf):
    df = table(spark, sf, "lineitem")
    paired = df.select(
        *C.with_prefix(df, "l_line")[:1], "l_orderkey", F.col("l_extendedprice").alias("extended_a"), F.col("l_discount").alias("discount_a")
    )
    return C.with_suffix(paired, "_a", ["l_orderkey", "l_linenumber"])


@query("prj_constant_tag", "SELECT doc_id, lang, 'train' AS split FROM documents")
def prj_constant_tag(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "lang").withColumn("split", F.lit("train"))


@query("prj_drop", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def prj_drop(spark, sf):
    return table(spark, sf, "customer").drop("c_nationkey", "c_mktsegment", "absent")


@query("prj_column_fallback", "SELECT conv_id, turn, text FROM conversations")
def prj_column_fallback(spark, sf):
    df = table(spark, sf, "conversations")
    name = C.first_existing(df, "caption", ["question", "text", "questions"])
    return df.select("conv_id", "turn", F.col(name).alias("text"))


@query("prj_missing_default", "SELECT s_suppkey, s_name, 'clip' AS backbone FROM supplier")
def prj_missing_default(spark, sf):
    return C.with_default(table(spark, sf, "supplier"), "backbone", "clip").select("s_suppkey", "s_name", "backbone")


@query(
    "prj_vector_expand",
    "SELECT vec_id, label, "
    + ", ".join(f"{rs(f'CAST(embedding[{i + 1}] AS DOUBLE)')} AS text_{i + 1}" for i in range(64))
    + " FROM embeddings",
)
def prj_vector_expand(spark, sf):
    df = table(spark, sf, "embeddings")
    # vectors held as list text, as some files store them
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<double>").cast("array<string>"), ", "), F.lit("]"))
    parsed = df.select("vec_id", "label", C.parse_vector(text).alias("v"))
    wide = C.expand_vector(parsed, "v", 64, "text_")
    return wide.select("vec_id", "label", *[r(F.col(c)).alias(c) for c in C.with_prefix(wide, "text_")])


# Filters


@query("flt_notnull", "SELECT c_custkey, c_acctbal FROM customer WHERE nullif(c_mktsegment, 'MACHINERY') IS NOT NULL")
def flt_notnull(spark, sf):
    df = table(spark, sf, "customer").withColumn("seg", F.nullif("c_mktsegment", F.lit("MACHINERY")))
    return df.filter(C.not_missing(df, "seg")).select("c_custkey", "c_acctbal")


@query(
    "flt_dropna_subset",
    """SELECT vec_id, label FROM embeddings
       WHERE label <> 0 AND list_count(list_filter(embedding, lambda x: x > 0.3)) = 0""",
)
def flt_dropna_subset(spark, sf):
    df = table(spark, sf, "embeddings").select(
        "vec_id",
        F.when(F.col("label") != 0, F.col("label")).alias("label"),
        F.transform("embedding", lambda x: F.when(x > 0.3, F.lit(float("nan"))).otherwise(x.cast("double"))).alias("emb"),
    )
    return C.drop_missing(df, ["label", "emb"]).select("vec_id", "label")


@query(
    "flt_blank_text",
    """WITH t AS (SELECT doc_id, lang, CASE WHEN lang = 'fr' THEN '  ' || chr(10) ELSE text END AS text FROM documents)
       SELECT lang, count(*) AS n_rows, CAST(sum(CASE WHEN regexp_matches(text, '\\S') THEN 1 ELSE 0 END) AS BIGINT) AS kept,
              CAST(sum(CASE WHEN regexp_matches(text, '\\S') THEN 0 ELSE 1 END) AS BIGINT) AS dropped FROM t GROUP BY lang""",
)
def flt_blank_text(spark, sf):
    df = table(spark, sf, "documents")
    df = df.withColumn("text", F.when(F.col("lang") == "fr", "  \n").otherwise(F.col("text")))
    keep = C.not_blank("text")
    return df.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(keep).alias("kept"), F.count_if(~keep).alias("dropped")
    )


EPI = "CAST(year({w}) * 100 + (dayofyear({w}) - 1) // 7 + 1 AS INTEGER)"


def epi_sql(day: str) -> str:
    wed = f"(CAST({day} AS DATE) + CAST(3 - dayofweek({day}) AS INTEGER))"
    return EPI.format(w=wed)


@query(
    "flt_week_range",
    f"SELECT o_orderkey, {epi_sql('o_orderdate')} AS week FROM orders WHERE {epi_sql('o_orderdate')} > 199545 AND {epi_sql('o_orderdate')} < 199901",
)
def flt_week_range(spark, sf):
    df = table(spark, sf, "orders")
    # the weeks bound the dates, so the range also reaches the scan
    near = (F.col("o_orderdate") >= F.lit("1995-11-01").cast("timestamp")) & (F.col("o_orderdate") < F.lit("1999-01-08").cast("timestamp"))
    df = df.filter(near).select("o_orderkey", N.epiweek(F.col("o_orderdate").cast("date")).alias("week"))
    return df.filter((F.col("week") > 199545) & (F.col("week") < 199901))


UNCERTAIN = """(SELECT doc_id, CASE WHEN quality = 0 AND toxic = 1 THEN -1 WHEN quality = 0 THEN NULL ELSE quality END AS quality,
                       CASE WHEN quality = 1 AND toxic = 1 THEN NULL ELSE toxic END AS toxic FROM labels)"""


def uncertain(spark, sf):
    q, t = F.col("quality"), F.col("toxic")
    return table(spark, sf, "labels").select(
        "doc_id",
        F.when((q == 0) & (t == 1), -1).when(q == 0, F.lit(None)).otherwise(q).alias("quality"),
        F.when((q == 1) & (t == 1), F.lit(None)).otherwise(t).alias("toxic"),
    )


@query(
    "flt_uncertain_labels",
    f"""SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {UNCERTAIN} u
        WHERE coalesce(quality, 0) <> -1 AND coalesce(toxic, 0) <> -1""",
)
def flt_uncertain_labels(spark, sf):
    return C.drop_uncertain(uncertain(spark, sf), ["quality", "toxic"])


@query("flt_isin", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def flt_isin(spark, sf):
    df = table(spark, sf, "orders")
    return df.filter((F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_totalprice")


# documents stand for rows with a file; pages are the file manifest: name = page number, size = length of the page
@query(
    "flt_valid_asset",
    """SELECT d.doc_id, d.source FROM documents d
       WHERE d.lang <> 'de' AND trim(nullif(d.source, 'src3')) NOT IN ('', 'nan')
         AND CAST(d.doc_id AS VARCHAR) || '.jpg' IN (SELECT CAST(page_id AS VARCHAR) || '.jpg' FROM pages WHERE length(html) > 0)""",
)
def flt_valid_asset(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id",
        "source",
        (F.col("lang") != "de").alias("hasImage"),
        F.nullif("source", F.lit("src3")).alias("url"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".jpg")).alias("name"),
    )
    return C.valid_asset(df, page_files(spark, sf), "hasImage", "url", "name").select("doc_id", "source")


def page_files(spark, sf):
    return table(spark, sf, "pages").select(
        F.concat(F.col("page_id").cast("string"), F.lit(".jpg")).alias("name"), F.length("html").cast("long").alias("length")
    )


@query(
    "flt_min_class_support",
    """WITH o AS (SELECT o_orderkey, 'c' || o_custkey AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders),
            e AS (SELECT o_orderkey, unnest([a, b]) AS c FROM o), k AS (SELECT c FROM e GROUP BY c HAVING count(*) >= 20)
       SELECT o_orderkey, a || ', ' || b AS label FROM o WHERE a IN (SELECT c FROM k) OR b IN (SELECT c FROM k)""",
)
def flt_min_class_support(spark, sf):
    buyer = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    df = table(spark, sf, "orders").select("o_orderkey", F.concat_ws(", ", buyer, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("label"))
    return A.frequent_labels(df, "o_orderkey", S.split_labels(F.col("label")), 20)


@query(
    "flt_parseable_vector",
    """SELECT vec_id, label, len(embedding) AS dims FROM embeddings WHERE label NOT IN (3, 4)""",
)
def flt_parseable_vector(spark, sf):
    text = F.concat(F.lit("["), F.array_join(F.col("embedding").cast("array<string>"), ", "), F.lit("]"))
    df = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.when(F.col("label") == 3, F.lit(None)).when(F.col("label") == 4, "missing").otherwise(text).alias("t")
    )
    v = C.parse_vector(F.col("t"))
    return df.withColumn("v", v).filter("v is not null").select("vec_id", "label", F.size("v").cast("long").alias("dims"))


@query(
    "flt_fill_blank",
    "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), '') AS segment, coalesce(nullif(c_name, 'Customer#000000001'), '') AS name FROM customer",
)
def flt_fill_blank(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey", F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.nullif("c_name", F.lit("Customer#000000001")).alias("name")
    )
    return df.na.fill("")


# Sorts, limits, sets


@query("srt_multi_key", "SELECT p_brand, p_type, p_partkey, row_number() OVER (ORDER BY p_brand, p_type DESC, p_partkey) - 1 AS position FROM part")
def srt_multi_key(spark, sf):
    df = table(spark, sf, "part").select("p_brand", "p_type", "p_partkey").orderBy("p_brand", F.col("p_type").desc(), "p_partkey")
    return sets.numbered(df)


ORDER = ["5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT"]


@query(
    "srt_category_order",
    f"""SELECT o_orderpriority, list_position({ORDER}, o_orderpriority) AS place, count(*) AS n, row_number() OVER (ORDER BY list_position({ORDER}, o_orderpriority)) - 1 AS position FROM orders
        GROUP BY 1, 2""",
)
def srt_category_order(spark, sf):
    counts = A.value_counts(table(spark, sf, "orders"), "o_orderpriority")
    place = sets.category_rank(F.col("o_orderpriority"), ORDER).cast("int")
    return sets.numbered(counts.select("o_orderpriority", place.alias("place"), "n").orderBy("place"))


@query("srt_by_key", "SELECT CAST(ts AS DATE) AS day, count(*) AS n, row_number() OVER (ORDER BY CAST(ts AS DATE)) - 1 AS position FROM events GROUP BY 1")
def srt_by_key(spark, sf):
    df = A.value_counts(table(spark, sf, "events").select(F.to_date("ts").alias("day")), "day").orderBy("day")
    return sets.numbered(df)


@query("lim_first_valid", "SELECT doc_id, lang FROM documents WHERE n_chars > 500 ORDER BY md5('42|' || doc_id), doc_id LIMIT 10")
def lim_first_valid(spark, sf):
    return sets.first_valid(table(spark, sf, "documents"), F.col("n_chars") > 500, "doc_id", 10).select("doc_id", "lang")


@query("lim_argmax", "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings")
def lim_argmax(spark, sf):
    from twinlens.functions.vectors import argmax

    return table(spark, sf, "embeddings").select("vec_id", argmax(F.col("embedding")).alias("top"))


@query(
    "set_union_all",
    """SELECT doc_id AS id, text, 'train' AS split FROM documents UNION ALL SELECT item_id, text, 'test' FROM benchmark
       UNION ALL SELECT conv_id, text, 'val' FROM conversations""",
)
def set_union_all(spark, sf):
    parts = [("documents", "doc_id", "train"), ("benchmark", "item_id", "test"), ("conversations", "conv_id", "val")]
    return sets.union_all(*[table(spark, sf, t).select(F.col(k).alias("id"), "text", F.lit(s).alias("split")) for t, k, s in parts])


@query(
    "set_union_missing",
    """SELECT s_suppkey AS id, s_name AS name, s_acctbal AS balance, CAST(NULL AS VARCHAR) AS segment FROM supplier
       UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def set_union_missing(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    c = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment")
    )
    return sets.union_all(s, c, missing=True)


@query("set_distinct", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def set_distinct(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "set_unseen_labels",
    """SELECT DISTINCT source AS label FROM documents d WHERE doc_id NOT IN (SELECT doc_id FROM labels)
         AND source NOT IN (SELECT d.source FROM documents d JOIN labels l USING (doc_id) WHERE l.quality = 0)""",
)
def set_unseen_labels(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("label"))
    labels = table(spark, sf, "labels")
    train = docs.join(labels.filter("quality = 0"), "doc_id", "left_semi")
    other = docs.join(labels, "doc_id", "left_anti")
    return sets.unseen_labels(train, other, "label")


@query("set_label_vocab", "SELECT DISTINCT label FROM (SELECT lang AS label FROM documents UNION ALL SELECT source FROM documents)")
def set_label_vocab(spark, sf):
    return sets.label_vocabulary(table(spark, sf, "documents"), "lang", "source")


# Strings


@query("str_strip_extension", "SELECT page_id, split_part(url, '.', 1) AS stem, regexp_replace(url || '.jpeg', '\\.(jpg|jpeg|png|tiff)', '', 'g') AS bare FROM pages")
def str_strip_extension(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").select(
        "page_id", S.stem(url).alias("stem"), S.drop_image_extension(F.concat(url, F.lit(".jpeg"))).alias("bare")
    )


@query(
    "str_pad_image_id",
    """SELECT o_orderkey, lpad(CAST(o_orderkey AS VARCHAR), 12, '0') || '.jpg' AS short_id,
              CAST(o_orderkey + 100000000000 AS VARCHAR) AS long_id FROM orders""",
)
def str_pad_image_id(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        "o_orderkey", S.padded_image_id(k).alias("short_id"), S.padded_image_id(k + F.lit(100000000000)).alias("long_id")
    )


TAIL = "regexp_extract(url, '^https?://[^/]*(/[^?#]*)', 1)"


@query("str_path_join", f"SELECT page_id, CASE WHEN starts_with(p, '/') THEN p ELSE 'images/' || p END AS path FROM (SELECT page_id, CASE WHEN url LIKE 'https%' THEN {TAIL} ELSE substr({TAIL}, 2) END AS p FROM pages)")
def str_path_join(spark, sf):
    tail = F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1)
    p = F.when(F.col("url").startswith("https"), tail).otherwise(F.substring(tail, F.lit(2), F.length(tail)))
    return table(spark, sf, "pages").select("page_id", S.join_path("images/", p).alias("path"))


@query(
    "str_resolve_extension",
    """WITH f AS (SELECT split_part(n, '.', 1) AS stem, min(n) AS file FROM
                  (SELECT CAST(page_id AS VARCHAR) || CASE WHEN url LIKE 'https%' THEN '.png' ELSE '.jpg' END AS n FROM pages) GROUP BY 1),
            d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || CASE WHEN lang = 'de' THEN '.gif' ELSE '' END AS name FROM documents)
       SELECT doc_id, name, CASE WHEN name LIKE '%.%' THEN name ELSE coalesce(file, name) END AS resolved FROM d LEFT JOIN f ON name = stem""",
)
def str_resolve_extension(spark, sf):
    ext = F.when(F.col("url").startswith("https"), ".png").otherwise(".jpg")
    files = table(spark, sf, "pages").select(F.concat(F.col("page_id").cast("string"), ext).alias("name"), F.length("html").alias("length"))
    docs = table(spark, sf, "documents").select(
        "doc_id", F.concat(F.col("doc_id").cast("string"), F.when(F.col("lang") == "de", ".gif").otherwise("")).alias("name")
    )
    return S.resolve_extension(docs, "name", files, "resolved")


@query("str_ensure_suffix", "SELECT doc_id, CASE WHEN ends_with(n, '.jpg') THEN n ELSE n || '.jpg' END AS file FROM (SELECT doc_id, source || CASE WHEN lang = 'en' THEN '.jpg' ELSE '' END AS n FROM documents)")
def str_ensure_suffix(spark, sf):
    n = F.concat(F.col("source"), F.when(F.col("lang") == "en", ".jpg").otherwise(""))
    return table(spark, sf, "documents").select("doc_id", S.ensure_suffix(n, ".jpg").alias("file"))


@query(
    "str_fix_double_ext",
    """WITH f AS (SELECT source || '.jpg' || CASE WHEN lang = 'de' THEN '' ELSE '.jpg' END AS n, n_chars FROM documents),
            c AS (SELECT CASE WHEN ends_with(n, '.jpg.jpg') THEN left(n, length(n) - 4) ELSE n END AS name, ends_with(n, '.jpg.jpg') AS d, n_chars FROM f)
       SELECT name, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY d, n_chars) AS rn FROM c) WHERE rn = 1""",
)
def str_fix_double_ext(spark, sf):
    name = F.concat("source", F.lit(".jpg"), F.when(F.col("lang") == "de", "").otherwise(".jpg"))
    return S.repair_double_extension(table(spark, sf, "documents").select(name.alias("name"), "n_chars"), "name")


@query(
    "str_regex_extract",
    "SELECT p_partkey, 'image_' || regexp_extract('see image' || p_size || ' of ' || p_name, 'image(\\d+)', 1) AS image_id FROM part",
)
def str_regex_extract(spark, sf):
    q = F.concat(F.lit("see image"), F.col("p_size").cast("string"), F.lit(" of "), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("image_"), S.digits_after(q, "image")).alias("image_id"))


@query("str_regex_replace", "SELECT p_partkey, 'what is left of the ' || p_name AS question FROM part")
def str_regex_replace(spark, sf):
    q = F.concat(F.lit("what is left of the "), F.col("p_name"), F.lit(" in the image"), F.col("p_size").cast("string"), F.lit(" ? "))
    return table(spark, sf, "part").select("p_partkey", S.cut_image_phrase(q).alias("question"))


@query("str_path_class", f"SELECT page_id, split_part(substr({TAIL}, 2), '/', 1) AS class FROM pages")
def str_path_class(spark, sf):
    tail = F.regexp_extract("url", r"^https?://[^/]*(/[^?#]*)", 1)
    tail = F.substring(tail, F.lit(2), F.length(tail))
    return table(spark, sf, "pages").select("page_id", S.first_part(tail).alias("class"))


@query(
    "str_path_rebuild",
    """SELECT c_custkey, replace(replace(parts[-1], 'image', parts[-2]), '.tiff', '.jpg') AS file
       FROM (SELECT c_custkey, string_split('data/' || c_mktsegment || '/image_' || c_nationkey || '.tiff', '/') AS parts FROM customer)""",
)
def str_path_rebuild(spark, sf):
    path = F.concat(F.lit("data/"), F.col("c_mktsegment"), F.lit("/image_"), F.col("c_nationkey").cast("string"), F.lit(".tiff"))
    folder = F.element_at(F.split(path, "/"), -2)
    name = F.replace(F.replace(S.last_part(path), F.lit("image"), folder), F.lit(".tiff"), F.lit(".jpg"))
    return table(spark, sf, "customer").select("c_custkey", name.alias("file"))


@query("str_from_comma", "SELECT doc_id, CASE WHEN strpos(text, ',') > 0 THEN substr(text, strpos(text, ',')) ELSE '' END AS tail FROM documents")
def str_from_comma(spark, sf):
    return table(spark, sf, "documents").select("doc_id", S.from_first(F.col("text"), ",").alias("tail"))


@query("str_split_explode", "SELECT p_partkey, unnest([p_type, p_brand, p_name]) AS label FROM part")
def str_split_explode(spark, sf):
    joined = F.concat_ws(", ", "p_type", "p_brand", "p_name")
    return table(spark, sf, "part").select("p_partkey", F.explode(S.split_labels(joined)).alias("label"))


@query("str_display_key", "SELECT p_partkey, upper(p_name) || ' - ' || p_type AS architecture, replace(p_brand, '#', '') AS brand FROM part")
def str_display_key(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", S.display_key(F.col("p_name"), F.col("p_type")).alias("architecture"), S.remove_literal(F.col("p_brand"), "#").alias("brand")
    )


@query(
    "str_value_map",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 END AS code,
              CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '5-LOW' THEN 'Low' ELSE o_orderpriority END AS label FROM orders""",
)
def str_value_map(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey",
        S.map_values(F.col("o_orderstatus"), {"F": 0, "O": 1, "P": 2}, F.lit(None).cast("int")).alias("code"),
        S.map_values(F.col("o_orderpriority"), {"1-URGENT": "Urgent", "5-LOW": "Low"}).alias("label"),
    )


@query("str_from_marker", "SELECT page_id, CASE WHEN strpos(url, 'example') > 0 THEN substr(url, strpos(url, 'example')) ELSE '' END AS tail FROM pages")
def str_from_marker(spark, sf):
    return table(spark, sf, "pages").select("page_id", S.from_first(F.col("url"), "example").alias("tail"))


@query("str_model_slug", "SELECT p_partkey, p_name || '-' || p_size AS slug, p_type || '_' || p_name || '-' || p_size || '_predictions.csv' AS file FROM part")
def str_model_slug(spark, sf):
    name = F.concat(F.lit("hub/"), F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("-"), F.col("p_size").cast("string"), F.lit("//"))
    slug = S.model_slug(name)
    return table(spark, sf, "part").select("p_partkey", slug.alias("slug"), F.concat("p_type", F.lit("_"), slug, F.lit("_predictions.csv")).alias("file"))


# Numbers and dates


@query(
    "num_dirty_parse",
    f"""SELECT c_custkey, CASE WHEN c_mktsegment = 'MACHINERY' OR c_mktsegment = 'BUILDING' THEN NULL ELSE {rs('c_acctbal')} END AS amount FROM customer""",
)
def num_dirty_parse(spark, sf):
    cents = F.format_string("%.2f", "c_acctbal")
    dirty = F.replace(F.replace(cents, F.lit("."), F.lit(",")), F.lit("0"), F.lit("O"))
    seg = F.col("c_mktsegment")
    value = F.when(seg == "MACHINERY", N.UNKNOWN_DURATION).when(seg == "BUILDING", F.lit(None)).otherwise(dirty)
    return table(spark, sf, "customer").select("c_custkey", r(N.dirty_number(value)).alias("amount"))


@query(
    "num_try_cast",
    """SELECT event_id, TRY_CAST(CASE WHEN event_type = 'click' THEN 'n/a' ELSE regexp_extract(props, '([0-9]+)', 1) END AS DOUBLE) AS k FROM events""",
)
def num_try_cast(spark, sf):
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(F.regexp_extract("props", "([0-9]+)", 1))
    return table(spark, sf, "events").select("event_id", text.try_cast("double").alias("k"))


GRADE_SQL = "(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1 END)"


def grade():
    g = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return F.when(F.col("o_orderstatus") != "P", g)


@query("num_recode_binary", f"SELECT o_orderkey, CASE WHEN {GRADE_SQL} > 0 THEN 1 ELSE 0 END AS DR_2 FROM orders")
def num_recode_binary(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.any_grade(grade()).alias("DR_2"))


@query("num_recode_three", f"SELECT o_orderkey, CASE WHEN {GRADE_SQL} = 4 THEN 2 WHEN {GRADE_SQL} IN (1, 2, 3) THEN 1 ELSE 0 END AS DR_3 FROM orders")
def num_recode_three(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", N.three_grades(grade()).alias("DR_3"))


@query("num_recode_flags", "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END AS insulin, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS male FROM customer")
def num_recode_flags(spark, sf):
    text = F.when(F.col("c_acctbal") > 0, "yes").otherwise("no")
    sex = F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(2)
    return table(spark, sf, "customer").select("c_custkey", N.yes_flag(text).alias("insulin"), N.sex_flag(sex).alias("male"))


@query(
    "num_quantile_bins",
    """WITH q AS (SELECT event_type AS t, quantile_cont(value, [1.0/3, 2.0/3]) AS c3, quantile_cont(value, 0.5) AS c2 FROM events GROUP BY 1)
       SELECT event_id, CAST(value > c3[1] AS INTEGER) + CAST(value > c3[2] AS INTEGER) AS bin3, CAST(value > c2 AS INTEGER) AS bin2
       FROM events JOIN q ON event_type = t""",
)
def num_quantile_bins(spark, sf):
    df = table(spark, sf, "events").select("event_id", "event_type", "value")
    return N.quantile_bins(df, "value", {"bin3": 3, "bin2": 2}, "event_type").select("event_id", "bin3", "bin2")


@query("dt_parse_epiweek", f"SELECT o_orderkey, {epi_sql('o_orderdate')} AS week FROM orders")
def dt_parse_epiweek(spark, sf):
    week = N.epiweek(F.col("o_orderdate").cast("date"))
    text = F.concat(F.floor(week / 100).cast("string"), F.lit("/w"), F.lpad((week % 100).cast("string"), 2, "0"))
    return table(spark, sf, "orders").select("o_orderkey", N.parse_epiweek(text).alias("week"))


@query("dt_epiweek", f"SELECT event_id, {epi_sql('ts')} AS week, {epi_sql('ts')} AS swapped FROM events")
def dt_epiweek(spark, sf):
    a, b = F.date_format("ts", "yyyy/MM/dd"), F.date_format("ts", "MM-dd-yyyy")
    return table(spark, sf, "events").select("event_id", N.epiweek_from_text(a).alias("week"), N.epiweek_from_text(b).alias("swapped"))


@query(
    "fmt_ci_cell",
    """SELECT p_brand, round(avg(p_retailprice) / 1000, 3) AS estimate, round(min(p_retailprice) / 1000, 3) AS ci_low,
              round(max(p_retailprice) / 1000, 3) AS ci_high FROM part GROUP BY p_brand""",
)
def fmt_ci_cell(spark, sf):
    agg = table(spark, sf, "part").groupBy("p_brand").agg(*[(f("p_retailprice") / 1000).alias(n) for f, n in ((F.avg, "e"), (F.min, "a"), (F.max, "z"))])
    cell = interval_cell(F.col("e"), F.col("a"), F.col("z"))
    parts = F.split(F.regexp_replace(cell, r"[\[\],]", ""), " ")
    names = ["estimate", "ci_low", "ci_high"]
    return agg.withColumn("p", parts).select("p_brand", *[F.col("p")[i].cast("double").alias(n) for i, n in enumerate(names)])
