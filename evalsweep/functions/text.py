"""Text column functions used by prompt building and scoring.

Everything here is a built-in JVM expression, so scoring never leaves the
executor JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values -----------------------------------------------------------
# Characters that count as white space (Python's str.strip / str.split set).
WHITESPACE = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
# ASCII punctuation, deleted before texts are compared.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Words dropped before texts are compared.
ARTICLES = ("a", "an", "the")
# Anonymisation marker removed from questions.
PLACEHOLDER = "[[placeholder]]"
# ------------------------------------------------------------------------

_WORD = r"[\p{L}\p{N}_]"
_LONE_CHOICE = rf"(?<!{_WORD})([A-Fa-f])(?!{_WORD})"
_FIRST_OPTION = "[A-Ea-e]"
_ANSWER_BODY = r"(?s)<(?:answer|response)>(.*?)</(?:answer|response)>"


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode spaces included."""
    return F.trim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Split on runs of white space; no empty members."""
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.array_remove(F.split(spaced, " "), "")


def normalize_text(text: Column) -> Column:
    """Comparison form: lower case, no punctuation, no articles, single spaces.

    One ``translate`` both deletes punctuation and maps every white-space
    character to a blank, which lets the split use Java's literal fast path.
    """
    plain = F.translate(F.lower(text), WHITESPACE + PUNCTUATION, " " * len(WHITESPACE))
    # A lambda rather than nested array_remove calls: those unroll into loops
    # that push the generated method past the size the JVM will compile.
    tokens = F.filter(F.split(plain, " "), lambda word: ~word.isin("", *ARTICLES))
    return F.array_join(tokens, " ")


def extract_choice(text: Column) -> Column:
    """First standalone letter A-F, else first visible character, upper-cased.

    Blank text is returned as it is.
    """
    visible = strip(text)
    letter = F.regexp_extract(text, _LONE_CHOICE, 1)
    first = F.substring(F.concat(letter, F.substring(visible, 1, 1)), 1, 1)
    return F.when(visible == "", text).otherwise(F.upper(first))


def first_option_letter(text: Column) -> Column:
    """First letter A-E anywhere in the text, upper-cased; empty if none."""
    return F.upper(F.regexp_extract(text, _FIRST_OPTION, 0))


def is_letter(text: Column) -> Column:
    return F.regexp_like(text, F.lit(r"\A\p{L}\z"))


def clean_question(text: Column) -> Column:
    """Drop every anonymisation marker, then strip."""
    return strip(F.replace(text, F.lit(PLACEHOLDER), F.lit("")))


def answer_tag(text: Column) -> Column:
    """Stripped body of the first answer or response tag, else the text itself."""
    # The plain search spares texts without a tag the regular expression.
    tagged = F.contains(text, F.lit("<answer>")) | F.contains(text, F.lit("<response>"))
    has_pair = tagged & F.regexp_like(text, F.lit(_ANSWER_BODY))
    return F.when(has_pair, strip(F.regexp_extract(text, _ANSWER_BODY, 1))).otherwise(text)


def clean_response(text: Column) -> Column:
    """Model text as stored: missing becomes empty, the rest is stripped."""
    return F.coalesce(strip(text), F.lit(""))


def token_count(text: Column, reported: Column) -> Column:
    """Reported completion tokens; missing or zero falls back to the word count."""
    counted = F.greatest(F.size(words(text)), F.lit(1))
    return F.coalesce(F.nullif(reported.cast("int"), F.lit(0)), counted)


def _fraction_text(number: Column) -> Column:
    """Text of a double the way Python prints it: 10000000.0, 0.0001, 1e+16."""
    plain = number.cast("string")
    size = F.abs(number)
    long_form = F.regexp_replace(number.cast("decimal(38,20)").cast("string"), "0+$", "")
    long_form = F.when(F.endswith(long_form, F.lit(".")), F.concat(long_form, F.lit("0"))).otherwise(long_form)
    mantissa = F.regexp_replace(F.regexp_extract(plain, r"^(.*)E", 1), r"\.0$", "")
    power = F.regexp_extract(plain, r"E(-?\d+)$", 1).try_cast("int")
    sign = F.when(power < 0, F.lit("-")).otherwise(F.lit("+"))
    digits = F.abs(power).cast("string")
    digits = F.when(F.length(digits) < 2, F.concat(F.lit("0"), digits)).otherwise(digits)
    return (
        F.when(F.isnan(number), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
        .when(~F.contains(plain, F.lit("E")), plain)
        .when((size >= 1e-4) & (size < 1e16), long_form)
        .otherwise(F.concat(mantissa, F.lit("e"), sign, digits))
    )


def _quoted(text: Column) -> Column:
    """A string as it appears inside a printed Python list."""
    body = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    double_quoted = F.concat(F.lit('"'), body, F.lit('"'))
    single_quoted = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    only_single = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(only_single, double_quoted).otherwise(single_quoted)


def plain_text(value: Column, dtype: T.DataType) -> Column:
    """Text of a value as Python's ``str`` shows it; NULL becomes ``None``.

    Lists show as bracketed Python lists.
    """
    if isinstance(dtype, T.ArrayType):
        inner = dtype.elementType

        def shown(item: Column) -> Column:
            if isinstance(inner, T.StringType):
                return F.coalesce(_quoted(item), F.lit("None"))
            return plain_text(item, inner)

        text = F.concat(F.lit("["), F.array_join(F.transform(value, shown), ", "), F.lit("]"))
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(value.cast("string"))
    elif isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = _fraction_text(value)
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit("None"))


def joined_list(value: Column, inner: T.DataType) -> Column:
    """List value as ``; ``-separated text; NULL members show as ``None``."""
    return F.array_join(F.transform(value, lambda item: plain_text(item, inner)), "; ")
