"""Templates of file names: digit runs as classes, merged over lengths, and the time format a name holds."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewheel.functions.text import digit_template

#: Parts of a time format with what they match, orders of a date's parts, separators, and ways to write the time of day, longest first. Fixed values.
PARTS = {"yyyy": "(?:19|20)[0-9]{2}", "yy": "[0-9]{2}", "MM": "(?:0[1-9]|1[0-2])", "dd": "(?:0[1-9]|[12][0-9]|3[01])", "HH": "(?:[01][0-9]|2[0-3])", "mm": "[0-5][0-9]", "SSS": "[0-9]{3}", "ss": "[0-5][0-9]"}
ORDERS = (("yyyy", "MM", "dd"), ("dd", "MM", "yyyy"), ("MM", "dd", "yyyy"), ("yy", "MM", "dd"), ("dd", "MM", "yy"))
SEPARATORS = ("-", "/", ".", "_", "")
TIMES = ("HH:mm:ss.SSS", "HH:mm:ss", "HH-mm-ss", "HH_mm_ss", "HHmmss", "HH:mm", "HH_mm", "HHmm")
#: Date formats that names are tried for; each may go on with a blank, T, _ or - and a time of day.
DATES = tuple(s.join(o) for s in SEPARATORS for o in ORDERS)


def matcher(time_format: str) -> str:
    """The regex of what a format of PARTS can have written."""
    return re.sub("|".join(PARTS) + "|[.]", lambda m: PARTS.get(m[0], "[.]"), time_format)


def templates(names: DataFrame, column: str) -> DataFrame:
    r"""template, n, widths: names that differ in digits only share one; lengths of a digit run become {min, max}."""
    rows = names.where(F.col(column).isNotNull()).select(F.col(column).alias("name"))
    shape = F.array_join(F.transform(F.regexp_extract_all("name", F.lit("[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.lit("\\d")).otherwise(p)), "")
    runs = F.transform(F.regexp_extract_all("name", F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r))
    per = rows.groupBy(shape.alias("shape"), runs.alias("runs")).agg(F.count(F.lit(1)).alias("n"))
    spread = per.select("shape", "n", F.posexplode_outer("runs").alias("pos", "width"))
    widths = spread.where("pos is not null").groupBy("shape", "pos").agg(F.min("width").alias("lo"), F.max("width").alias("hi"))
    listed = widths.groupBy("shape").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("w"))
    total = per.groupBy("shape").agg(F.sum("n").alias("n"))
    text = F.transform("w", lambda x: F.when(x["lo"] == x["hi"], F.concat(F.lit("\\d{"), x["lo"].cast("string"), F.lit("}"))).otherwise(F.concat(F.lit("\\d{"), x["lo"].cast("string"), F.lit(", "), x["hi"].cast("string"), F.lit("}"))))
    return total.join(listed, "shape", "left").select("shape", "n", F.coalesce(F.array_join(text, "|"), F.lit("")).alias("widths"))


def named(names: DataFrame, column: str) -> DataFrame:
    r"""names with regex: what matches every name that differs from it in digits only, a run of digits as \d{min,max}.

    Null names have a null regex; the empty name's is empty. Literal text is escaped.
    """
    tokens = F.regexp_extract_all(column, F.lit("[0-9]+|[^0-9]+"), F.lit(0))
    rows = names.withColumn("_shape", F.transform(tokens, lambda t: F.when(t.rlike("^[0-9]"), F.lit("")).otherwise(t)))
    per = rows.where("_shape is not null").groupBy("_shape", F.transform(F.regexp_extract_all(column, F.lit("[0-9]+"), F.lit(0)), lambda r: F.length(r)).alias("runs")).count()
    widths = per.select("_shape", F.posexplode("runs").alias("pos", "width")).groupBy("_shape", "pos").agg(F.min("width").alias("lo"), F.max("width").alias("hi"))
    listed = widths.groupBy("_shape").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("w"))
    size = lambda x: F.concat(F.lit("\\d{"), F.concat_ws(",", x["lo"].cast("string"), F.when(x["hi"] > x["lo"], x["hi"].cast("string"))), F.lit("}"))
    plain = lambda t: F.regexp_replace(t, r"([.^$|?*+(){}\[\]\\])", r"\\$1")
    # digits and other text alternate, so the i-th token is the (i / 2)-th run of digits or of other text
    text = F.array_join(F.transform("_shape", lambda t, i: F.when(t == "", size(F.get("w", F.floor(i / 2).cast("int")))).otherwise(plain(t))), "")
    return rows.join(listed, "_shape", "left").withColumn("regex", text).drop("_shape", "w")


#: Tokens of a name: a decimal number that is no piece of a dotted chain (as in versions and addresses), a whole number, a word, anything else.
TOKENS = r"(?<![0-9.])[0-9]+[.][0-9]+(?![.]?[0-9])|[0-9]+|[A-Za-z]+|[^A-Za-z0-9]+"


def tokens(names: DataFrame, column: str) -> DataFrame:
    r"""names with _tokens and template: decimal numbers as \d.\d, whole ones as \d, the rest as it is."""
    rows = names.where(F.col(column).isNotNull()).withColumn("_tokens", F.regexp_extract_all(column, F.lit(TOKENS), F.lit(0)))
    shape = F.transform("_tokens", lambda t: F.when(t.rlike("^[0-9]+[.]"), F.lit("\\d.\\d")).when(t.rlike("^[0-9]"), F.lit("\\d")).otherwise(t))
    return rows.withColumn("template", F.array_join(shape, ""))


def numbered_parts(names: DataFrame, column: str) -> DataFrame:
    """template, position (of the token, from 0), part, kind (float or int), n, n_values, low, high: the numbers in names of
    one template.

    A number is named by the word that is joined to it (a unit behind it first, then one in front), else by the nearest
    word before it, else part<position>. Names without numbers, and null ones, have no rows.
    """
    word = lambda t: t.rlike("^[A-Za-z]+$")
    near = lambda i: F.when(word(F.get("_tokens", i)), F.get("_tokens", i))
    rows = tokens(names, column).select("template", "_tokens", F.posexplode("_tokens").alias("position", "_t")).where(F.col("_t").rlike("^[0-9]"))
    before = F.element_at(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.slice("_tokens", F.lit(1), F.col("position")), word)), -1)
    part = F.coalesce(near(F.col("position") + 1), near(F.col("position") - 1), before, F.concat(F.lit("part"), F.col("position").cast("string")))
    kind = F.when(F.col("_t").contains("."), F.lit("float")).otherwise(F.lit("int"))
    value = F.col("_t").cast("double")
    return rows.groupBy("template", "position", part.alias("part"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("_t").alias("n_values"), F.min(value).alias("low"), F.max(value).alias("high"))


def exact_templates(names: DataFrame, column: str) -> DataFrame:
    return names.where(F.col(column).isNotNull()).groupBy(digit_template(F.col(column)).alias("template")).agg(F.count(F.lit(1)).alias("n"))


def positions(names: DataFrame, column: str, split: str = r"[^A-Za-z0-9]+") -> DataFrame:
    """Per position among a name's parts: distinct values, and whether all are letters."""
    parts = names.select(F.posexplode(F.filter(F.split(column, split), lambda p: p != "")).alias("pos", "part"))
    return parts.groupBy("pos").agg(F.countDistinct("part").alias("n_values"), F.min(F.col("part").rlike("^[A-Za-z]+$")).alias("alpha"))


def time_format_votes(names: DataFrame, column: str) -> DataFrame:
    """format, votes: each name votes for all formats of its longest match, so that days and months are told by the names together.

    A match has valid months, days and times, and no digit beside it. The format of most votes is the names'; of equal
    ones the longer.
    """
    tail = f"(?:[ T_-]?(?:{'|'.join(map(matcher, TIMES))}))?"
    clock = F.create_map(*(F.lit(x) for t in TIMES for x in (re.sub("[A-Za-z]", "0", t), t)))

    def found(date: str) -> Column:
        text = F.regexp_extract(column, f"(?<![0-9])({matcher(date)}{tail})(?![0-9])", 1)
        rest = F.substring(text, len(date) + 1, 20)
        joiner = F.regexp_extract(rest, "^[^0-9]", 0)
        time = clock[F.translate(F.substring(rest, F.length(joiner) + 1, F.lit(20)), "123456789", "000000000")]
        return F.struct(F.length(text).alias("len"), F.concat(F.lit(date), F.when(joiner == "T", "'T'").otherwise(joiner), F.coalesce(time, F.lit(""))).alias("format"))

    hits = F.filter(F.array(*map(found, DATES)), lambda x: x["len"] > 0)
    longest = F.array_max(F.transform("_hits", lambda x: x["len"]))
    best = names.select(hits.alias("_hits")).select(F.explode(F.filter("_hits", lambda x: x["len"] == longest)).alias("x"))
    return best.groupBy(F.col("x.format").alias("format")).agg(F.count(F.lit(1)).alias("votes"))
