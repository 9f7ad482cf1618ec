"""Descriptions, prompts and answer parsing."""

from pyspark.sql import functions as F

from twinlens.functions import answers as Y
from twinlens.functions import prompt_texts as P
from twinlens.functions import text as T
from twinlens.operators.search import words_in_texts
from twinlens.workload.base import query, table

# Coded columns made of order and customer values, the same way in both engines.
# (name, SQL over part, so that flags, gaps and dirty numbers occur)


def bit(i: int) -> str:
    return f"CAST((p_partkey // {2 ** i}) % 2 AS INTEGER)"


def bit_col(i: int):
    return (F.expr(f"p_partkey div {2 ** i}") % 2).cast("int")


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HISTORY_SQL = "hist AS (SELECT p_partkey, p_type, CASE WHEN p_size % 3 < 2 THEN p_size % 3 END AS sex, CAST(nullif(p_size, 10) AS DOUBLE) AS age, CAST(nullif(p_size % 7, 0) AS DOUBLE) AS dm_time, CAST(nullif(p_size % 9, 0) AS DOUBLE) AS educational_level, " + ", ".join(
    f"{bit(i)} AS {name}" for i, (name, _, _) in enumerate(P.HISTORY_FLAGS)
) + " FROM part)"


def history(spark, sf):
    size = F.col("p_size")
    return table(spark, sf, "part").select(
        "p_partkey",
        "p_type",
        F.when(size % 3 < 2, size % 3).alias("sex"),
        F.nullif(size, F.lit(10)).cast("double").alias("age"),
        F.nullif(size % 7, F.lit(0)).cast("double").alias("dm_time"),
        F.nullif(size % 9, F.lit(0)).cast("double").alias("educational_level"),
        *[bit_col(i).alias(name) for i, (name, _, _) in enumerate(P.HISTORY_FLAGS)],
    )


def flag_sql(name: str) -> str:
    yes, no = next((y, n) for c, y, n in P.HISTORY_FLAGS if c == name)
    return f"CASE WHEN {name} = 1 THEN {q(yes)} ELSE {q(no)} END"


SCHOOL_SQL = "CASE educational_level " + " ".join(f"WHEN {k} THEN {q(v)}" for k, v in P.EDUCATION.items()) + f" ELSE {q(P.NO_EDUCATION)} END"
PATIENT_SQL = f"""('A ' || CASE sex WHEN 1 THEN 'male' WHEN 0 THEN 'female' ELSE 'sex not reported' END || ' patient '
    || coalesce('aged ' || age || ' years', 'with age not reported') || ', ' || coalesce('diagnosed with diabetes for ' || dm_time || ' years', 'with no reported diabetes duration')
    || ', ' || {flag_sql('insulin')} || ', and ' || {flag_sql('oraltreatment_dm')} || '. The patient is ' || {flag_sql('systemic_hypertension')} || ', ' || {flag_sql('alcohol_consumption')}
    || ', ' || {flag_sql('smoking')} || ', ' || {flag_sql('obesity')} || ', and ' || {flag_sql('vascular_disease')} || '. Medical history includes: ' || {flag_sql('acute_myocardial_infarction')}
    || ', ' || {flag_sql('nephropathy')} || ', ' || {flag_sql('neuropathy')} || ', and ' || {flag_sql('diabetic_foot')} || '. The patient is ' || {SCHOOL_SQL} || '.')"""


@query("txt_patient_description", f"WITH {HISTORY_SQL} SELECT p_partkey, {PATIENT_SQL} AS text FROM hist")
def txt_patient_description(spark, sf):
    return history(spark, sf).select("p_partkey", T.patient_description().alias("text"))


EXAM_COLUMNS = ["optic_disc", "vessels", "macula", *P.PROMPT_CONDITIONS]
EXAM_SQL = "exam AS (SELECT p_partkey, p_size % 3 AS exam_eye, p_size % 4 AS patient_sex, CASE WHEN p_size % 5 = 0 THEN NULL ELSE replace(CAST(p_size AS VARCHAR), '0', 'O') || ',5' END AS patient_age, CASE p_size % 6 WHEN 0 THEN NULL WHEN 1 THEN 'Não' ELSE CAST(p_size % 6 AS VARCHAR) END AS diabetes_time_y, nullif(p_type, 'ECONOMY') AS comorbidities, CASE WHEN p_size % 2 = 0 THEN 'no' ELSE 'yes' END AS insuline, " + ", ".join(
    f"{bit(i)}{' + 1' if i < 3 else ''} AS {c}" for i, c in enumerate(EXAM_COLUMNS)
) + " FROM part)"


def exams(spark, sf):
    size = F.col("p_size")
    dirty = F.concat(F.replace(size.cast("string"), F.lit("0"), F.lit("O")), F.lit(",5"))
    return table(spark, sf, "part").select(
        "p_partkey",
        (size % 3).alias("exam_eye"),
        (size % 4).alias("patient_sex"),
        F.when(size % 5 != 0, dirty).alias("patient_age"),
        F.when(size % 6 == 1, "Não").when(size % 6 > 1, (size % 6).cast("string")).alias("diabetes_time_y"),
        F.nullif("p_type", F.lit("ECONOMY")).alias("comorbidities"),
        F.when(size % 2 == 0, "no").otherwise("yes").alias("insuline"),
        *[(bit_col(i) + (1 if i < 3 else 0)).alias(c) for i, c in enumerate(EXAM_COLUMNS)],
    )


def present(c: str) -> str:
    return f"CASE WHEN {c} = 1 THEN 'present' ELSE 'absent' END"


AGE_SQL = "CAST(CAST(replace(replace(patient_age, 'O', '0'), ',', '.') AS DOUBLE) AS VARCHAR)"
TIME_SQL = "CAST(CAST(nullif(diabetes_time_y, 'Não') AS DOUBLE) AS VARCHAR)"
EXAM_TEXT_SQL = f"""('An image from the ' || CASE exam_eye WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'no eye reported' END || ' eye of a '
    || CASE patient_sex WHEN 1 THEN 'male' WHEN 2 THEN 'female' ELSE 'no sex reported' END || ' patient, aged ' || coalesce({AGE_SQL}, 'no age reported') || ' years, '
    || coalesce('with comorbidities: ' || comorbidities, 'with no comorbidities reported') || ', ' || coalesce('diabetes diagnosed for ' || {TIME_SQL} || ' years', 'with no diabetes duration reported')
    || ', ' || CASE WHEN insuline = 'no' THEN 'not using insulin' ELSE 'using insulin' END || '. The optic disc is ' || {present('optic_disc')} || ', vessels are ' || {present('vessels')}
    || ', and the macula is ' || {present('macula')} || '. ' || {" || ', ' || ".join(f"'{w}: ' || {present(c)}" for w, c in P.EXAM_CONDITIONS)} || '.')"""


@query("txt_exam_description", f"WITH {EXAM_SQL} SELECT p_partkey, {EXAM_TEXT_SQL} AS text FROM exam")
def txt_exam_description(spark, sf):
    return exams(spark, sf).select("p_partkey", T.exam_description().alias("text"))


def anatomy(c: str) -> str:
    return f"CASE {c} WHEN 1 THEN 'normal' WHEN 2 THEN 'abnormal' ELSE 'unknown' END"


EXAM_PROMPT_SQL = f"""('A ' || CASE WHEN patient_sex = 1 THEN 'male' WHEN patient_sex IN (0, 2) THEN 'female' ELSE 'sex not reported' END || ' patient '
    || coalesce('aged ' || {AGE_SQL} || ' years', 'with age not reported') || ', ' || coalesce('diagnosed with diabetes for ' || {TIME_SQL} || ' years', 'with no reported diabetes duration')
    || ', ' || CASE WHEN insuline = 'yes' THEN 'using insulin' ELSE 'not using insulin' END || ', and ' || coalesce('with comorbidities: ' || comorbidities, 'with no comorbidities reported')
    || '. The optic disc appears ' || {anatomy('optic_disc')} || ', the vessels are ' || {anatomy('vessels')} || ', and the macula is ' || {anatomy('macula')}
    || '. Conditions include: ' || {" || ', ' || ".join(f"'{c.replace('_', ' ')}: ' || {present(c)}" for c in P.PROMPT_CONDITIONS)} || '.')"""


@query(
    "txt_lesion_description",
    """SELECT doc_id, 'Patient diagnosed via ' || lang || '. Age: ' || coalesce(CAST(nullif(n_chars, 500) AS VARCHAR), 'No data reported') || ' years. Sex: '
         || coalesce(CASE WHEN quality = 1 THEN 'male' WHEN quality = 0 THEN 'female' END, 'No data reported') || '. Localization: ' || coalesce(nullif(source, 'src1'), 'No data reported') || '.' AS text
       FROM documents LEFT JOIN labels USING (doc_id)""",
)
def txt_lesion_description(spark, sf):
    df = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    df = df.select(
        "doc_id", F.col("lang").alias("dx_type"), F.nullif("n_chars", F.lit(500)).cast("double").alias("age"),
        F.when(F.col("quality") == 1, "male").when(F.col("quality") == 0, "female").alias("sex"), F.nullif("source", F.lit("src1")).alias("localization"),
    )
    return df.select("doc_id", T.lesion_description().alias("text"))


CITY_SQL = """(SELECT c_nationkey, n_name, count(*) AS n, count(*) FILTER (WHERE c_acctbal < 0) AS a, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS b,
     count(*) FILTER (WHERE c_mktsegment = 'MACHINERY') AS c, count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD') AS d FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)"""
CITY_TEXT_SQL = """('In a city called ' || n_name || ' with ' || CASE WHEN n > 60 THEN 1 ELSE 0 END || ' Dengue classification, ' || a || '% of the population is aged 0-4, ' || b || '% aged 5-14, '
     || c || '% are Afro-Colombian, and ' || d || '% are of Indian descent.')"""


@query("txt_city_description", f"SELECT c_nationkey, {CITY_TEXT_SQL} AS text, 'An image from city ' || n_name || ' taken in date 2018-01-07 with' || substr({CITY_TEXT_SQL}, strpos({CITY_TEXT_SQL}, ',')) AS dated FROM {CITY_SQL}")
def txt_city_description(spark, sf):
    seg = F.col("c_mktsegment")
    stats = table(spark, sf, "customer").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("a"), F.count_if(seg == "BUILDING").alias("b"),
        F.count_if(seg == "MACHINERY").alias("c"), F.count_if(seg == "HOUSEHOLD").alias("d"),
    )
    df = stats.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    label = F.when(F.col("n") > 60, 1).otherwise(0)
    df = df.withColumn("text", T.city_description(F.col("n_name"), label, F.col("a"), F.col("b"), F.col("c"), F.col("d")))
    return df.select("c_nationkey", "text", T.dated_city_description(F.col("n_name"), F.lit("2018-01-07"), F.col("text")).alias("dated"))


@query(
    "txt_code_converters",
    f"""WITH {EXAM_SQL} SELECT p_partkey, CASE exam_eye WHEN 1 THEN 'right' WHEN 2 THEN 'left' ELSE 'no eye reported' END AS eye, {present('scar')} AS scar, {anatomy('macula')} AS macula,
        CASE WHEN patient_sex = 1 THEN 'male' WHEN patient_sex IN (0, 2) THEN 'female' ELSE 'sex not reported' END AS sex_exam,
        CASE patient_sex WHEN 1 THEN 'male' WHEN 0 THEN 'female' ELSE 'sex not reported' END AS sex_history,
        CASE WHEN insuline = 'yes' THEN 'smokes' ELSE 'does not smoke' END AS flag FROM exam""",
)
def txt_code_converters(spark, sf):
    c = F.col
    return exams(spark, sf).select(
        "p_partkey", T.eye_word(c("exam_eye")).alias("eye"), T.presence_word(c("scar")).alias("scar"), T.anatomy_word(c("macula")).alias("macula"),
        T.sex_word_exam(c("patient_sex")).alias("sex_exam"), T.sex_word_history(c("patient_sex")).alias("sex_history"),
        T.flag_phrase(F.upper("insuline"), "smokes", "does not smoke").alias("flag"),
    )


BASE_SQL = "base AS (SELECT * FROM (VALUES " + ", ".join(f"({q(d)}, {q(t)}, {q(x)})" for d, t, x in P.BASE_PROMPTS) + ") v(dataset, task, template))"
EXTRA_SQL = "base AS (SELECT * FROM (VALUES " + ", ".join(f"({q(d)}, {q(t)}, {q(x)})" for d, t, x in [*P.BASE_PROMPTS, *P.SINGLE_MODALITY_PROMPTS]) + ") v(dataset, task, template))"


@query(
    "txt_task_prompt",
    f"""WITH {EXAM_SQL}, {HISTORY_SQL}, {EXTRA_SQL}
        SELECT p_partkey, dataset, task, md5(replace(template, '{{description}}', {EXAM_PROMPT_SQL})) AS prompt FROM exam, base WHERE dataset = 'brset'
        UNION ALL SELECT p_partkey, dataset, task, md5(replace(template, '{{description}}', {PATIENT_SQL})) FROM hist, base WHERE dataset = 'mbrset'""",
)
def txt_task_prompt(spark, sf):
    rows = [*P.BASE_PROMPTS, *P.SINGLE_MODALITY_PROMPTS]
    a = exams(spark, sf).select("p_partkey", F.lit("brset").alias("dataset"), T.exam_prompt_description().alias("d"))
    b = history(spark, sf).select("p_partkey", F.lit("mbrset").alias("dataset"), T.patient_description().alias("d"))
    templates = F.broadcast(spark.createDataFrame(rows, "dataset string, task string, template string"))
    filled = a.unionByName(b).join(templates, "dataset")
    return filled.select("p_partkey", "dataset", "task", F.md5(T.fill(F.col("template"), F.col("d"))).alias("prompt"))


def relaxed_sql(t: str) -> str:
    return f"trim(array_to_string(list_filter(string_split({t}, chr(10)), lambda x: NOT contains(x, {q(P.RULE_MARK)})), chr(10)), ' ' || chr(10))"


def strategy_sql(t: str, strategy: str, task: str) -> str:
    nl = "chr(10) || chr(10)"
    reasoned = f"{relaxed_sql(t)} || {nl} || {q(P.REASON_FIRST)}"
    return f"""CASE {strategy} WHEN 'cot' THEN {relaxed_sql(t)} || {nl} || CASE WHEN {task} = 'referable_dr' THEN {q(P.STEPS_REFERABLE)} ELSE {q(P.STEPS_BINARY)} END
        WHEN 'role' THEN {q(P.ROLE)} || {nl} || {t} WHEN 'base_grpo' THEN {reasoned} WHEN 'role_grpo' THEN {q(P.ROLE)} || {nl} || {reasoned} ELSE {t} END"""


STRATEGIES = ["base", "cot", "role", "base_grpo", "role_grpo"]


@query(
    "txt_strategy_transform",
    f"""WITH {HISTORY_SQL}, p AS (SELECT p_partkey, replace({q(P.BINARY)}, '{{description}}', {PATIENT_SQL}) AS prompt FROM hist), s AS (SELECT unnest({STRATEGIES}) AS strategy)
        SELECT p_partkey, strategy, md5({strategy_sql('prompt', 'strategy', "'binary_dr'")}) AS prompt FROM p, s""",
)
def txt_strategy_transform(spark, sf):
    df = history(spark, sf).select("p_partkey", T.fill(F.lit(P.BINARY), T.patient_description()).alias("prompt"))
    df = df.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in STRATEGIES])))
    changed = T.apply_strategy(F.col("prompt"), F.col("strategy"), F.lit("binary_dr"))
    return df.select("p_partkey", "strategy", F.md5(changed).alias("prompt"))


TASKS = ["binary_dr", "REFERABLE_DR", "5_class_dr", "3_class_dr", "glaucoma", "amd", "cataract"]


def known_sql() -> str:
    return " OR ".join(f"(strategy = '{s}' AND task IN ({', '.join(q(t) for t in tasks)}))" for s, tasks in P.STRATEGY_TASKS.items())


@query(
    "txt_prompt_dispatch",
    f"""WITH {BASE_SQL}, k AS (SELECT c_custkey, CASE WHEN c_acctbal > 3000 THEN 'BRSET' ELSE 'mbrset' END AS dataset, {TASKS}[c_nationkey % 7 + 1] AS task,
             {STRATEGIES + ['tree']}[c_custkey % 6 + 1] AS strategy FROM customer),
             j AS (SELECT c_custkey, strategy, b.task, template FROM k LEFT JOIN base b ON lower(k.dataset) = b.dataset AND lower(k.task) = b.task)
        SELECT c_custkey, md5(CASE WHEN {known_sql()} THEN {strategy_sql('template', 'strategy', 'task')} ELSE template END) AS template FROM j""",
)
def txt_prompt_dispatch(spark, sf):
    def pick(names, i):
        return F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))

    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") > 3000, "BRSET").otherwise("mbrset").alias("dataset"),
        pick(TASKS, F.col("c_nationkey") % 7).alias("task"),
        pick([*STRATEGIES, "tree"], F.col("c_custkey") % 6).alias("strategy"),
    )
    return T.dispatch(df, "dataset", "task", "strategy").select("c_custkey", F.md5("template").alias("template"))


@query(
    "txt_classification_prompt",
    f"""WITH l AS (SELECT string_agg(lang, ''', ''' ORDER BY lang) AS langs FROM (SELECT DISTINCT lang FROM documents))
        SELECT doc_id, md5({q(P.TASK_HEADER + P.SINGLE_LABEL)} || '[''' || langs || ''']' || {q('.' + chr(10) + 'Question/Text: ')} || text || {q(chr(10) + 'Answer directly with the class name(s).')}) AS closed,
               md5({q(P.TASK_HEADER + P.SINGLE_LABEL + P.CLASS_MEANINGS['fakeddit'] + '.' + chr(10) + 'Question/Text: ')} || text || {q(chr(10) + 'Answer directly with the class name(s).')}) AS fixed,
               md5({q(P.TASK_HEADER + P.MULTI_LABEL)} || '[''' || langs || ''']' || {q('. Select all that apply.' + chr(10) + 'Question/Text: ')} || text || {q(chr(10) + 'Answer directly with the class name(s).')}) AS many
        FROM documents, l""",
)
def txt_classification_prompt(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    # one row: every prompt holds the whole list anyway
    langs = docs.select(F.sort_array(F.collect_set("lang")).alias("langs"))
    t, names = F.col("text"), F.col("langs")
    return docs.join(langs, F.lit(True)).select(
        "doc_id",
        F.md5(T.classification_prompt(t, names)).alias("closed"),
        F.md5(T.classification_prompt(t, names, "fakeddit")).alias("fixed"),
        F.md5(T.classification_prompt(t, names, many=True)).alias("many"),
    )


@query("txt_description_prefix", f"WITH {HISTORY_SQL} SELECT p_partkey, {PATIENT_SQL} AS text FROM hist")
def txt_description_prefix(spark, sf):
    df = history(spark, sf).select("p_partkey", T.fill(F.lit(P.BINARY), T.patient_description()).alias("prompt"))
    return df.select("p_partkey", T.description_prefix(F.col("prompt")).alias("text"))


# Answers: every part answers with its type, alone, in a sentence, as a number or as junk

TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
WORDS = ["It is FAKE news", "looks real to me", "no dr", "Diabetic Retinopathy present", "0", "1 (Real)", "fakery", "", "negative, not positive", "surely 1"]
ANSWER_SQL = f"""ans AS (SELECT p_partkey, p_type, CASE p_size % 4 WHEN 0 THEN lower(p_type) WHEN 1 THEN 'I think it is ' || p_type || '.' WHEN 2 THEN 'sub' || p_type || 's' ELSE 'no idea' END AS answer,
    {WORDS}[p_partkey % {len(WORDS)} + 1] AS word FROM part)"""


def answered(spark, sf):
    kind = F.col("p_type")
    size = F.col("p_size") % 4
    answer = F.when(size == 0, F.lower(kind)).when(size == 1, F.concat(F.lit("I think it is "), kind, F.lit("."))).when(size == 2, F.concat(F.lit("sub"), kind, F.lit("s"))).otherwise("no idea")
    word = F.get(F.array(*[F.lit(w) for w in WORDS]), (F.col("p_partkey") % len(WORDS)).cast("int"))
    return table(spark, sf, "part").select("p_partkey", "p_type", answer.alias("answer"), word.alias("word"))


def types_array():
    return F.array(*[F.lit(t) for t in TYPES])


def whole(x: str) -> str:
    return f"regexp_matches(lower(answer), '(^|\\W)' || lower({x}) || '(\\W|$)')"


@query(
    "prs_strict",
    f"""WITH {ANSWER_SQL} SELECT p_partkey, list_filter({TYPES}, lambda x: {whole('x')})[1] AS category,
        CASE WHEN regexp_matches(lower(word), '^[01]\\b') THEN substr(word, 1, 1) WHEN regexp_matches(lower(word), '\\bfake\\b') THEN '0' WHEN regexp_matches(lower(word), '\\breal\\b') THEN '1'
             WHEN regexp_matches(word, '\\b0\\b') THEN '0' WHEN regexp_matches(word, '\\b1\\b') THEN '1' END AS authenticity,
        CASE WHEN regexp_matches(lower(word), '^[01]\\b') THEN substr(word, 1, 1) WHEN regexp_matches(lower(word), '\\b(no diabetic retinopathy|no dr|negative)\\b') THEN '0'
             WHEN regexp_matches(lower(word), '\\b(diabetic retinopathy|dr|positive)\\b') THEN '1' WHEN regexp_matches(word, '\\b0\\b') THEN '0' WHEN regexp_matches(word, '\\b1\\b') THEN '1' END AS retinopathy FROM ans""",
)
def prs_strict(spark, sf):
    binary = F.array(F.lit("0"), F.lit("1"))
    return answered(spark, sf).select(
        "p_partkey",
        Y.strict_label(F.col("answer"), types_array()).alias("category"),
        Y.strict_label(F.col("word"), binary, "fakeddit").alias("authenticity"),
        Y.strict_label(F.col("word"), binary, "mbrset").alias("retinopathy"),
    )


@query("prs_substring_default", f"WITH {ANSWER_SQL} SELECT p_partkey, coalesce(list_filter({TYPES}, lambda x: contains(lower(answer), lower(x)))[1], '{TYPES[0]}') AS parsed FROM ans")
def prs_substring_default(spark, sf):
    return answered(spark, sf).select("p_partkey", Y.substring_label(F.col("answer"), types_array()).alias("parsed"))


@query(
    "prs_inverted_legacy",
    f"""WITH {ANSWER_SQL} SELECT p_partkey, CASE WHEN regexp_matches(word, '^0\\b') THEN 1 WHEN regexp_matches(word, '^1\\b') THEN 0
        WHEN regexp_matches(lower(word), '\\breal\\b') THEN 1 WHEN regexp_matches(lower(word), '\\bfake\\b') THEN 0 END AS parsed FROM ans""",
)
def prs_inverted_legacy(spark, sf):
    return answered(spark, sf).select("p_partkey", Y.inverted_label(F.col("word")).alias("parsed"))


@query("prs_multilabel_columns", "SELECT p_partkey, " + ", ".join(f"CAST(contains(lower(p_name), '{w}') AS INTEGER) AS {w}" for w in ("red", "ring", "widget", "small")) + " FROM part")
def prs_multilabel_columns(spark, sf):
    return table(spark, sf, "part").select("p_partkey", *Y.named_labels(F.upper("p_name"), ["red", "ring", "widget", "small"]))


@query(
    "prs_multilabel_vocab",
    """WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part WHERE p_size > 10)
       SELECT p_partkey, w AS label, 1 AS hit FROM part, v WHERE contains(lower(p_name || ' ' || p_type), lower(w))""",
)
def prs_multilabel_vocab(spark, sf):
    df = table(spark, sf, "part")
    words = df.filter("p_size > 10").select(F.explode(F.split("p_name", " ")).alias("w"))
    texts = df.select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return words_in_texts(texts, "p_partkey", "text", words).withColumn("hit", F.lit(1))


@query("prs_active_labels", "SELECT doc_id, coalesce(nullif(concat_ws(', ', CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END), ''), 'No Finding') AS label FROM labels")
def prs_active_labels(spark, sf):
    from twinlens.functions.strings import active_labels

    return table(spark, sf, "labels").select("doc_id", active_labels(["quality", "toxic"]).alias("label"))
