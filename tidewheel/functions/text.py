"""Names and status texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prettify(name: Column) -> Column:
    """Words split at blanks and underscores, each with a capital first letter."""
    words = F.filter(F.split(name, "[ _]+"), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))), " ")


def status_minutes(status: Column) -> Column:
    """'5 min' is 5, 'On Time' is 0; anything else is null."""
    return F.when(status == "On Time", F.lit(0)).when(status.rlike(r"^\d{1,9} min$"), F.regexp_extract(status, r"^(\d{1,9}) min$", 1).try_cast("int"))


def digit_template(name: Column) -> Column:
    r"""Each run of digits replaced by \d{its length}."""
    return F.array_join(F.transform(F.regexp_extract_all(name, F.lit(r"[0-9]+|[^0-9]+"), F.lit(0)), lambda p: F.when(p.rlike("^[0-9]"), F.concat(F.lit("\\d{"), F.length(p).cast("string"), F.lit("}"))).otherwise(p)), "")
