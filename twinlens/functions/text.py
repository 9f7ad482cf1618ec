"""Descriptions and prompts from coded columns, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinlens.functions import prompt_texts as P
from twinlens.functions.numbers import UNKNOWN_DURATION, dirty_number

WHITE = " \n\t\r"


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def _if_known(c: Column, before: str, after: str, unknown: str) -> Column:
    return F.coalesce(_say(before, c.cast("string"), after), F.lit(unknown))


# Converters of codes to words. The codes and the words they stand for.


def eye_word(c: Column) -> Column:
    return F.when(c == 1, "right").when(c == 2, "left").otherwise("no eye reported")


def presence_word(c: Column) -> Column:
    """1, yes and true (as text) are present, all else absent."""
    return F.when(F.lower(c.cast("string")).isin("1", "yes", "true"), "present").otherwise("absent")


def anatomy_word(c: Column) -> Column:
    return F.when(c == 1, "normal").when(c == 2, "abnormal").otherwise("unknown")


def sex_word_exam(c: Column) -> Column:
    """1 / 2 coding and words; 0 counts as female."""
    s = F.lower(c.cast("string"))
    return (
        F.when(s.isin("1", "male", "m", "masculino"), "male")
        .when(s.isin("2", "female", "f", "feminino", "0"), "female")
        .otherwise("sex not reported")
    )


def sex_word_history(c: Column) -> Column:
    """1 / 0 coding."""
    n = c.try_cast("int")
    return F.when(n == 1, "male").when(n == 0, "female").otherwise("sex not reported")


def flag_phrase(c: Column, yes: str, no: str) -> Column:
    hit = (c.try_cast("int") == 1) | F.lower(c.cast("string")).isin("yes", "true", "1")
    return F.when(hit, yes).otherwise(no)


# Descriptions


def patient_description() -> Column:
    """Patient history in words. Columns: sex, age, dm_time, educational_level and the flags."""
    flag = {name: flag_phrase(F.col(name), yes, no) for name, yes, no in P.HISTORY_FLAGS}
    level = F.col("educational_level").cast("double")
    school = F.lit(P.NO_EDUCATION)
    for code, words in P.EDUCATION.items():
        school = F.when(level == float(code), words).otherwise(school)
    age = _if_known(F.col("age"), "aged ", " years", "with age not reported")
    time = _if_known(F.col("dm_time"), "diagnosed with diabetes for ", " years", "with no reported diabetes duration")
    return _say(
        "A ", sex_word_history(F.col("sex")), " patient ", age, ", ", time, ", ",
        flag["insulin"], ", and ", flag["oraltreatment_dm"],
        ". The patient is ", flag["systemic_hypertension"], ", ", flag["alcohol_consumption"], ", ",
        flag["smoking"], ", ", flag["obesity"], ", and ", flag["vascular_disease"],
        ". Medical history includes: ", flag["acute_myocardial_infarction"], ", ", flag["nephropathy"], ", ",
        flag["neuropathy"], ", and ", flag["diabetic_foot"],
        ". The patient is ", school, ".",
    )


def _number_words(c: Column) -> Column:
    return dirty_number(c).cast("string")


def exam_description() -> Column:
    """Eye exam in words, one presence word per structure and condition."""

    def word(name):
        return F.when(F.col(name) == 1, "present").otherwise("absent")

    sex = F.when(F.col("patient_sex") == 1, "male").when(F.col("patient_sex") == 2, "female").otherwise("no sex reported")
    age = F.coalesce(_number_words(F.col("patient_age")), F.lit("no age reported"))
    duration = F.col("diabetes_time_y")
    known = duration.isNotNull() & (duration != UNKNOWN_DURATION)
    diabetes = F.when(known, _say("diabetes diagnosed for ", _number_words(duration), " years")).otherwise(
        "with no diabetes duration reported"
    )
    insulin = F.when(F.col("insuline") == "no", "not using insulin").otherwise("using insulin")
    listed = F.concat_ws(", ", *[_say(w, ": ", word(c)) for w, c in P.EXAM_CONDITIONS])
    return _say(
        "An image from the ", eye_word(F.col("exam_eye")), " eye of a ", sex, " patient, aged ", age, " years, ",
        _if_known(F.col("comorbidities"), "with comorbidities: ", "", "with no comorbidities reported"), ", ",
        diabetes, ", ", insulin,
        ". The optic disc is ", word("optic_disc"), ", vessels are ", word("vessels"), ", and the macula is ",
        word("macula"), ". ", listed, ".",
    )


def exam_prompt_description() -> Column:
    """Eye exam in the words of the prompts."""
    duration = F.col("diabetes_time_y")
    known = duration.isNotNull() & (duration != UNKNOWN_DURATION)
    age = F.when(F.col("patient_age").isNotNull(), _say("aged ", _number_words(F.col("patient_age")), " years"))
    time = F.when(known, _say("diagnosed with diabetes for ", _number_words(duration), " years"))
    insulin = F.when(F.lower(_trim(F.col("insuline"))) == "yes", "using insulin").otherwise("not using insulin")
    listed = F.concat_ws(", ", *[_say(c.replace("_", " "), ": ", presence_word(F.col(c))) for c in P.PROMPT_CONDITIONS])
    return _say(
        "A ", sex_word_exam(F.col("patient_sex")), " patient ", F.coalesce(age, F.lit("with age not reported")), ", ",
        F.coalesce(time, F.lit("with no reported diabetes duration")), ", ", insulin, ", and ",
        _if_known(F.col("comorbidities"), "with comorbidities: ", "", "with no comorbidities reported"),
        ". The optic disc appears ", anatomy_word(F.col("optic_disc")), ", the vessels are ",
        anatomy_word(F.col("vessels")), ", and the macula is ", anatomy_word(F.col("macula")),
        ". Conditions include: ", listed, ".",
    )


def lesion_description() -> Column:
    none = "No data reported"
    age = F.coalesce(F.col("age").cast("int").cast("string"), F.lit(none))
    return _say(
        "Patient diagnosed via ", F.col("dx_type"), ". Age: ", age, " years. Sex: ",
        F.coalesce("sex", F.lit(none)), ". Localization: ", F.coalesce("localization", F.lit(none)), ".",
    )


def city_description(city: Column, label: Column, young: Column, school: Column, afro: Column, native: Column) -> Column:
    def s(c):
        return c.cast("string")

    return _say(
        "In a city called ", city, " with ", s(label), " Dengue classification, ", s(young),
        "% of the population is aged 0-4, ", s(school), "% aged 5-14, ", s(afro),
        "% are Afro-Colombian, and ", s(native), "% are of Indian descent.",
    )


def dated_city_description(city: Column, day: Column, text: Column) -> Column:
    """The city text from its first comma on, behind a new opening."""
    from twinlens.functions.strings import from_first

    return _say("An image from city ", city, " taken in date ", day, " with", from_first(text, ","))


# Prompts


def fill(template: Column, description: Column) -> Column:
    return F.replace(template, F.lit("{description}"), description)


def relax(prompt: Column) -> Column:
    """Drops the lines with the answer rule and outer white space."""
    kept = F.filter(F.split(prompt, "\n"), lambda line: ~F.contains(line, F.lit(P.RULE_MARK)))
    return _trim(F.array_join(kept, "\n"))


def apply_strategy(prompt: Column, strategy: Column, task: Column) -> Column:
    """The base prompt in the wording of a strategy; unknown strategies keep it."""
    steps = F.when(task == "referable_dr", P.STEPS_REFERABLE).otherwise(P.STEPS_BINARY)
    reasoned = _say(relax(prompt), "\n\n" + P.REASON_FIRST)
    return (
        F.when(strategy == "cot", _say(relax(prompt), "\n\n", steps))
        .when(strategy == "role", _say(P.ROLE + "\n\n", prompt))
        .when(strategy == "base_grpo", reasoned)
        .when(strategy == "role_grpo", _say(P.ROLE + "\n\n", reasoned))
        .otherwise(prompt)
    )


def template_table(spark: SparkSession) -> DataFrame:
    """(dataset, task, strategy, template): the 31 prompts of the dispatch."""
    rows = [(d, t, "base", text) for d, t, text in P.BASE_PROMPTS]
    for strategy, tasks in P.STRATEGY_TASKS.items():
        rows += [(d, t, strategy, text) for d, t, text in P.BASE_PROMPTS if t in tasks]
    base = spark.createDataFrame(rows, "dataset string, task string, strategy string, template string")
    return base.withColumn("template", apply_strategy(F.col("template"), F.col("strategy"), F.col("task")))


def dispatch(df: DataFrame, dataset: str, task: str, strategy: str, out: str = "template") -> DataFrame:
    """Adds the template of (dataset, task, strategy), any case; falls back to the base
    strategy, then to null. The template table is a constant of 31 rows."""
    table = F.broadcast(template_table(df.sparkSession))
    exact = table.select(*[F.col(c).alias(f"__e_{c}") for c in table.columns])
    base = table.filter("strategy = 'base'").select(*[F.col(c).alias(f"__b_{c}") for c in table.columns])
    d, t, s = (F.lower(F.col(c)) for c in (dataset, task, strategy))
    joined = df.join(
        F.broadcast(exact), (d == F.col("__e_dataset")) & (t == F.col("__e_task")) & (s == F.col("__e_strategy")), "left"
    ).join(F.broadcast(base), (d == F.col("__b_dataset")) & (t == F.col("__b_task")), "left")
    return joined.select(*df.columns, F.coalesce("__e_template", "__b_template").alias(out))


def classification_prompt(text: Column, labels: Column | Sequence[str], dataset: str | None = None, many: bool = False) -> Column:
    """Task header, closed label list or fixed class meaning, the text, the answer rule."""
    if isinstance(labels, Column):
        listed = _say("['", F.array_join(labels, "', '"), "']")
    else:
        listed = F.lit(str(list(labels)))
    if many:
        choice = _say(P.MULTI_LABEL, listed, ". Select all that apply.\n")
    elif (dataset or "").lower() in P.CLASS_MEANINGS:
        choice = F.lit(P.SINGLE_LABEL + P.CLASS_MEANINGS[dataset.lower()] + ".\n")
    else:
        choice = _say(P.SINGLE_LABEL, listed, ".\n")
    return _say(P.TASK_HEADER, choice, "Question/Text: ", text, "\nAnswer directly with the class name(s).")


def description_prefix(prompt: Column) -> Column:
    """The prompt before its question."""
    return F.substring_index(prompt, "\n\nBased on", 1)


def wrap(text: Column, wrapper: tuple[str, str]) -> Column:
    return _say(wrapper[0], text, wrapper[1])
