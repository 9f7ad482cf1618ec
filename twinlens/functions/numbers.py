"""Numeric cleaning, grade recodes and epidemiological weeks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinlens.operators.ranking import exact_quantiles, null_safe
from twinlens.session import small_side

# Fixed value: the word that stands for "not known" in the duration column.
UNKNOWN_DURATION = "Não"


def dirty_number(c: Column) -> Column:
    """Letter O read as zero, decimal comma as dot; sentinel and unparseable text give null."""
    s = F.when(c != UNKNOWN_DURATION, c)
    return F.replace(F.replace(s, F.lit("O"), F.lit("0")), F.lit(","), F.lit(".")).try_cast("double")


def any_grade(c: Column) -> Column:
    return F.when(c > 0, 1).otherwise(0)


def three_grades(c: Column) -> Column:
    return F.when(c == 4, 2).when(c.isin(1, 2, 3), 1).otherwise(0)


def yes_flag(c: Column) -> Column:
    return F.when(c == "yes", 1).otherwise(0)


def sex_flag(c: Column) -> Column:
    """1/2 coding to 1/0."""
    return F.when(c == 1, 1).otherwise(0)


def quantile_bins(df: DataFrame, value: str, classes: int | Mapping[str, int], group: str, out: str = "bin") -> DataFrame:
    """Equal-frequency classes 0..classes-1 inside each group; two classes split at the median.

    A value belongs to the class given by the number of thresholds strictly below it. Values that are no number give no class.
    ``classes`` may name several outputs with a number of classes each; all their thresholds come from one run.
    """
    wanted = {out: classes} if isinstance(classes, int) else dict(classes)
    of = {name: [i / n for i in range(1, n)] for name, n in wanted.items()}
    v = F.col(value).try_cast("double")
    qs = sorted({q for each in of.values() for q in each})
    table = exact_quantiles(df.select(group, v.alias("__v")), "__v", qs, [group])
    limits = [F.array_sort(F.collect_list(F.when(F.col("q").isin(each), F.col("value")))).alias(f"__t_{name}") for name, each in of.items()]
    table = small_side(table.groupBy(F.col(group).alias("__g")).agg(*limits))
    joined = df.join(table, null_safe(df, table, [(group, "__g")]), "left")
    below = {name: F.when(v.isNotNull(), F.size(F.filter(f"__t_{name}", lambda t: t < v))) for name in of}
    return joined.withColumns(below).select(*df.columns, *of)


def parse_epiweek(c: Column) -> Column:
    """``2018/w07`` to 201807."""
    year = F.regexp_extract(c, r"^\D*(\d+)", 1).try_cast("int")
    week = F.regexp_extract(c, r"/w?(\d+)", 1).try_cast("int")
    return year * 100 + week


def epiweek(day: Column) -> Column:
    """YYYYWW of the Sunday-start week, owned by the year of its Wednesday."""
    wed = F.date_add(day, F.lit(4) - F.dayofweek(day))
    return F.year(wed) * 100 + F.floor((F.dayofyear(wed) - 1) / 7).cast("int") + 1


def epiweek_from_text(c: Column) -> Column:
    """Date text ``Y-M-D`` (or ``/``), letters dropped; when the first number is below 1000
    the order is month, day, year."""
    parts = F.transform(F.split(F.replace(c, F.lit("/"), F.lit("-")), "-"), lambda p: F.regexp_replace(p, r"\D", "").cast("int"))
    a, b, d = parts[0], parts[1], parts[2]
    year, month, day = F.when(a < 1000, d).otherwise(a), F.when(a < 1000, a).otherwise(b), F.when(a < 1000, b).otherwise(d)
    return epiweek(F.make_date(year, month, day))
