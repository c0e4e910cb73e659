"""From question tables of varying layout to prompts and reference answers.

A dataset is either a table with fixed columns, where the schema decides which
alias is present, or a table of map-typed records, where each record's keys do.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evalsweep.functions.measures import OPTIONS_MARKER
from evalsweep.functions.text import clean_question, joined_list, plain_text, strip
from evalsweep.operators.rules import Rule

# Column names looked for, in this order ---------------------
QUESTION_KEYS = ("question", "text", "input", "prompt")
ANSWER_KEYS = ("answer", "label", "output", "target")
CHOICE_KEYS = ("alternatives", "choices")
# Options whose letters are looked up; those of later ones are computed.
KNOWN_LABELS = 1024
# ------------------------------------------------------------------------

# Own wording; pass other texts to reproduce the prompts of an existing run.
CHOICE_SYSTEM = "Answer the multiple-choice question with the letter of the right option only."
ESSAY_SYSTEM = "Answer the question in full sentences and give your reasons."


def _present(df: DataFrame, keys: Sequence[str]) -> str | None:
    return next((key for key in keys if key in df.columns), None)


def question_value(value: Column, dtype: T.DataType) -> Column:
    """Question text of one value; lists are joined, NULL becomes ``None``."""
    if isinstance(dtype, T.ArrayType):
        return F.coalesce(joined_list(value, dtype.elementType), F.lit("None"))
    return plain_text(value, dtype)


def _first_key(record: Column, keys: Sequence[str], value_of) -> Column:
    """Value under the first key that is present, even if that value is NULL."""
    chain = None
    for key in keys:
        hit, value = F.map_contains_key(record, key), value_of(F.try_element_at(record, F.lit(key)))
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return chain


def resolve_question(
    df: DataFrame, keys: Sequence[str] = QUESTION_KEYS, record: str | None = None, name: str = "question"
) -> DataFrame:
    """Add the question text; a keyless record gets NULL, a keyless table fails."""
    if record is not None:
        inner = df.schema[record].dataType.valueType
        return df.withColumn(name, _first_key(F.col(record), keys, lambda v: question_value(v, inner)))
    key = _present(df, keys)
    if key is None:
        raise KeyError(f"none of the question columns {list(keys)} in {df.columns}")
    return df.withColumn(name, question_value(F.col(key), df.schema[key].dataType))


def resolve_answer(
    df: DataFrame, keys: Sequence[str] = ANSWER_KEYS, record: str | None = None, name: str = "reference"
) -> DataFrame:
    """Add the stripped reference answer; empty text when no alias is present."""
    if record is not None:
        inner = df.schema[record].dataType.valueType
        text = _first_key(F.col(record), keys, lambda v: strip(plain_text(v, inner)))
        return df.withColumn(name, F.coalesce(text, F.lit("")))
    key = _present(df, keys)
    if key is None:
        return df.withColumn(name, F.lit(""))
    return df.withColumn(name, strip(plain_text(F.col(key), df.schema[key].dataType)))


def has_any_key(record: Column, keys: Sequence[str] = QUESTION_KEYS) -> Column:
    return F.arrays_overlap(F.map_keys(record), F.array(*[F.lit(key) for key in keys]))


def question_given(record: str, keys: Sequence[str] = QUESTION_KEYS) -> Rule:
    """Records without a question under any alias, for ``rules.admit``: kept, dropped and counted in one pass."""
    given = F.coalesce(has_any_key(F.col(record), keys), F.lit(False))
    return Rule(f"question:{record}", ~given, F.lit("no question under " + ", ".join(keys)))


def drop_keyless(df: DataFrame, record: str, keys: Sequence[str] = QUESTION_KEYS) -> DataFrame:
    """Keep the records that carry a question under any alias."""
    return df.filter(has_any_key(F.col(record), keys))


def count_keyless(df: DataFrame, record: str, keys: Sequence[str] = QUESTION_KEYS) -> DataFrame:
    """One row: how many records are kept and how many are dropped."""
    kept = F.coalesce(has_any_key(F.col(record), keys), F.lit(False))
    return df.agg(F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_dropped"))


def _label(position: Column) -> Column:
    """A, B, C and on by code point; ``char`` alone starts again after 256."""
    point = position + 65
    wide = F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32")
    return F.when(point < 256, F.char(point)).otherwise(wide)


def _lettered_lines(items: Column, inner: T.DataType) -> Column:
    """Lines of a list, lettered; what stands before the first options is a constant list, looked up."""
    heads = F.split(F.lit("\n".join(f"  {chr(65 + i)}. " for i in range(KNOWN_LABELS))), "\n")

    def line(item: Column, i: Column) -> Column:
        later = F.concat(F.lit("  "), _label(i), F.lit(". "))
        return F.concat(F.when(i < KNOWN_LABELS, F.get(heads, i)).otherwise(later), plain_text(item, inner))

    return F.array_join(F.transform(items, line), "\n")


def _option_lines(pairs: Column) -> Column:
    """Lines of a list of (label, text) structs."""
    return F.array_join(
        F.transform(pairs, lambda p: F.concat(F.lit("  "), p["label"], F.lit(". "), p["text"])), "\n"
    )


def _zipped_lines(texts: Column, labels: Column) -> Column:
    """Option lines up to the end of the shorter list."""
    shorter = F.least(F.size(texts), F.size(labels))
    return _option_lines(
        F.arrays_zip(
            F.slice(labels, F.lit(1), shorter).alias("label"),
            F.slice(texts, F.lit(1), shorter).alias("text"),
        )
    )


def _texts(items: Column, inner: T.DataType) -> Column:
    return F.transform(items, lambda item: plain_text(item, inner))


def format_options(choices: Column, dtype: T.DataType) -> Column:
    """Options as ``  X. text`` lines.

    A map or a struct of texts is listed by key, and prints no options when it
    holds a NULL.  Lists under ``text`` and ``label`` are zipped up to the
    shorter one, and lettered when there are no labels.  A plain list is
    lettered.  Any other layout prints no options.
    """
    if isinstance(dtype, T.ArrayType):
        return _lettered_lines(choices, dtype.elementType)
    if isinstance(dtype, T.MapType):
        if isinstance(dtype.valueType, T.StringType):
            pairs = F.transform(
                F.array_sort(F.map_entries(choices)),
                lambda e: F.struct(e["key"].alias("label"), e["value"].alias("text")),
            )
            complete = ~F.exists(F.map_values(choices), lambda v: v.isNull())
            return F.when(complete, _option_lines(pairs)).otherwise(F.lit(""))
        if not isinstance(dtype.valueType, T.ArrayType):
            return F.lit("")
        inner = dtype.valueType.elementType
        listed = F.try_element_at(choices, F.lit("text"))
        texts, labels = _texts(listed, inner), _texts(F.try_element_at(choices, F.lit("label")), inner)
        lettered = _lettered_lines(listed, inner)
        return F.coalesce(
            F.when(F.map_contains_key(choices, "label"), _zipped_lines(texts, labels)).otherwise(lettered),
            F.lit(""),
        )
    fields = {field.name: field.dataType for field in dtype.fields}
    if all(isinstance(kind, T.StringType) for kind in fields.values()):
        pairs = F.array(
            *[F.struct(F.lit(n).alias("label"), choices[n].alias("text")) for n in sorted(fields)]
        )
        complete = ~F.exists(pairs, lambda p: p["text"].isNull())
        return F.when(complete, _option_lines(pairs)).otherwise(F.lit(""))
    if not isinstance(fields.get("text"), T.ArrayType):
        return F.lit("")
    if not isinstance(fields.get("label"), T.ArrayType):
        return _lettered_lines(choices["text"], fields["text"].elementType)
    texts = _texts(choices["text"], fields["text"].elementType)
    return _zipped_lines(texts, _texts(choices["label"], fields["label"].elementType))


def _filled(choices: Column, dtype: T.DataType) -> Column:
    """Choices count when they are there and not empty."""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return choices.isNotNull() & (F.coalesce(F.size(choices), F.lit(0)) > 0)
    return choices.isNotNull()


def first_choices(df: DataFrame, keys: Sequence[str] = CHOICE_KEYS, render: bool = False) -> Column:
    """First choice column that is present and filled, NULL when there is none.

    With ``render`` the value is the option text, so that columns of different
    layout can stand in for each other.
    """
    chain = None
    for key in (key for key in keys if key in df.columns):
        dtype = df.schema[key].dataType
        value = format_options(F.col(key), dtype) if render else F.col(key)
        hit = _filled(F.col(key), dtype)
        chain = F.when(hit, value) if chain is None else chain.when(hit, value)
    return F.lit(None).cast("string") if chain is None else chain


def build_prompt(
    question: Column,
    options: Column | None = None,
    choice_system: str = CHOICE_SYSTEM,
    essay_system: str = ESSAY_SYSTEM,
) -> Column:
    """Prompt text; a question with options gets the multiple-choice layout."""
    cleaned = clean_question(question)
    essay = F.concat(F.lit(f"{essay_system}\n\nQuestion: "), cleaned, F.lit("\n\nAnswer:"))
    if options is None:
        return essay
    choice = F.concat(
        F.lit(f"{choice_system}\n\nQuestion: "),
        cleaned,
        F.lit(f"\n\n{OPTIONS_MARKER}\n"),
        options,
        F.lit("\n\nAnswer:"),
    )
    return F.when(options.isNotNull(), choice).otherwise(essay)


def build_samples(
    df: DataFrame,
    id_col: str,
    question_keys: Sequence[str] = QUESTION_KEYS,
    answer_keys: Sequence[str] = ANSWER_KEYS,
    choice_keys: Sequence[str] = CHOICE_KEYS,
    record: str | None = None,
    choice_system: str = CHOICE_SYSTEM,
    essay_system: str = ESSAY_SYSTEM,
) -> DataFrame:
    """Dataset table to ``(sample_idx, prompt, reference)``; one narrow pass."""
    if record is not None:
        df = drop_keyless(df, record, question_keys)
    with_question = resolve_question(df, question_keys, record, "_question")
    resolved = resolve_answer(with_question, answer_keys, record, "_reference")
    has_choices = any(key in df.columns for key in choice_keys)
    options = first_choices(df, choice_keys, render=True) if has_choices else None
    return resolved.select(
        F.col(id_col).alias("sample_idx"),
        build_prompt(F.col("_question"), options, choice_system, essay_system).alias("prompt"),
        F.col("_reference").alias("reference"),
    )


def chat_messages(prompt: Column) -> Column:
    """A prompt as a conversation of one user turn."""
    return F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content")))
