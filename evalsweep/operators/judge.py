"""Reading the replies of a judge model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalsweep.functions.judging import INCORRECT, verdict

# What Python's float takes, bar blanks around it.
_DIGITS = r"\d(?:_?\d)*"
_NUMBER = rf"(?i)\A[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf|infinity|nan)\z"
_JSON_OPTIONS = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def parse_judge_replies(df: DataFrame, reply: str = "reply", name: str = "verdict") -> DataFrame:
    """Add the score and label found in each free-text reply, as one struct.

    The widest ``{...}`` in the reply (else all of it) must be exactly one JSON
    object.  A missing score is 0.0 and a missing label ``incorrect``; anything
    unreadable scores (0.0, incorrect).  A score in a text is read as Python reads
    a number, and a label that is true or false is spelt as Python spells it.
    ``from_json`` alone accepts trailing
    text, so the body is parsed twice, as the only member of an array and as a
    value inside an object: text that follows the object breaks one of the two.

    The steps are separate projections because each value is used several times.
    """
    found = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    bodies = df.withColumn("_found", found).withColumn(
        "_body", F.when(F.col("_found") != "", F.col("_found")).otherwise(F.col(reply))
    )
    body = F.col("_body")
    in_list = F.concat(F.lit("["), body, F.lit("]"))
    in_object = F.concat(F.lit('{"x":'), body, F.lit("}"))
    parsed = bodies.select(
        "*",
        F.from_json(in_list, "array<map<string,string>>", _JSON_OPTIONS).alias("_alone"),
        F.from_json(in_object, "struct<x:map<string,string>>", _JSON_OPTIONS)["x"].alias("_fields"),
    )

    def given(key: str) -> Column:
        """The entry of a key, NULL if absent; a key given twice holds its last value."""
        entries = F.filter(F.map_entries("_fields"), lambda entry: entry["key"] == key)
        return F.try_element_at(entries, F.lit(-1))

    readable = (F.size("_alone") == 1) & F.col("_fields").isNotNull()
    entries = parsed.select(
        "*",
        F.when(readable, given("score")).alias("_score"),
        F.when(readable, given("label")).alias("_label"),
        readable.alias("_readable"),
    )
    raw = F.col("_score.value")
    number = (
        F.when(F.col("_score").isNull(), F.lit(0.0))
        .when(raw == "true", F.lit(1.0))
        .when(raw == "false", F.lit(0.0))
        .when(F.regexp_like(F.trim(raw), F.lit(_NUMBER)), F.replace(raw, F.lit("_"), F.lit("")).try_cast("double"))
    )
    # The map holds texts only; the typed value tells true from "true".
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(body), "$.label", "variant"))
    shown = F.coalesce("_label.value", F.lit("None"))
    label = (
        F.when(F.col("_label").isNull(), F.lit(INCORRECT))
        # Only these texts can be of a boolean: others need no third parse.
        .when(shown.isin("true", "false") & (kind == "BOOLEAN"), F.initcap(shown))
        .otherwise(shown)
    )
    numbers = entries.select("*", number.alias("_number"))
    value = F.col("_number")
    # Failures are settled before the clamp: least and greatest skip NULLs.
    usable = F.col("_readable") & value.isNotNull() & ~F.isnan(value)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))
    return numbers.select(
        *df.columns,
        F.when(usable, F.struct(score.alias("judge_score"), label.alias("judge_label")))
        .otherwise(verdict(0.0, INCORRECT))
        .alias(name),
    )
