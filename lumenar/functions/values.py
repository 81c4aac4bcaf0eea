"""Cell values as Spark columns: null vocabularies, numbers, text normalisation, comparison."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two vocabularies that mean "no value", and the number words.
LOADER_NULLS = ("", "none", "null", "nan", "na", "n/a", "nil", "undefined", "empty", "<null>", "<none>", "<na>", "<nan>")
EVALUATION_NULLS = (
    "", "null", "none", "nan", "nil", "undefined", "empty", "undisclosed", "unspecified", "unknown",
    "n/a", "na", "n.a.", "na.", "n/a.", "not available", "not applicable",
)
NUMBER_WORDS = {
    "no": 0, "none": 0, "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6,
    "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12,
}

_NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
_BARE = r"\A[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\z"
_WHOLE = r"\A(0|[1-9]\d{0,17})\z"


def number(value: Column) -> Column:
    """A double, or null where the text is not a plain number (Java's suffixes such as ``1d`` are not)."""
    return F.when(value.rlike(_NUMERIC), F.trim(value).try_cast("double"))


def is_none_value(value: Column) -> Column:
    """Null by the loader's vocabulary."""
    return F.coalesce(F.lower(F.trim(value)).isin(*LOADER_NULLS), F.lit(True))


def is_null_eval(value: Column) -> Column:
    """Null by the evaluation's vocabulary."""
    return F.coalesce(F.lower(F.trim(value)).isin(*EVALUATION_NULLS), F.lit(True))


def money_text(value: Column) -> Column:
    """Text without thousands commas, a leading dollar sign and a trailing percent sign."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(value), ",", ""), r"^\$", ""), "%$", "")


def decimal_value(value: Column) -> Column:
    cleaned = money_text(value)
    return F.when(cleaned.rlike(_NUMERIC), F.trim(cleaned).try_cast("decimal(38,10)"))


def coerce_number(value: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.trim(value), ",", ""), r"^\$", "")
    return F.when(~is_none_value(value), number(text))


def word_number(value: Column) -> Column:
    """A number token: digits with signs, or one of the number words."""
    words = F.create_map(*[F.lit(x) for k, v in NUMBER_WORDS.items() for x in (k, float(v))])
    return F.coalesce(F.try_element_at(words, F.lower(F.trim(value))), number(money_text(value)))


def collapse(value: Column) -> Column:
    """Inner blanks collapsed, outer blanks and quotes removed."""
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"\s+", " "), r"^[ \t\r\n\"']+|[ \t\r\n\"']+$", "")


def normal_text(value: Column) -> Column:
    """Collapsed, without trailing punctuation, lower-cased."""
    return F.lower(F.regexp_replace(collapse(value), r"[\s.。:;；，,]+$", ""))


def alnum_text(value: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), "[^a-z0-9]+", " "))


def sql_value(value: Column) -> Column:
    """What a cell is in the relational tables: null words are NULL, numbers lose their signs, other text keeps its case."""
    cleaned = collapse(value)
    plain = money_text(cleaned)
    # a plain number is itself: told by one pattern, since a table's cells are mostly such
    return F.when(value.rlike(_BARE), value).when(is_null_eval(value), F.lit(None)).when(plain.rlike(_NUMERIC), plain).otherwise(F.regexp_replace(cleaned, r"[\s.。:;；，,]+$", ""))


def values_equal(left: Column, right: Column) -> Column:
    """Two nulls are equal, one is not; numbers compare as decimals, the rest as normal text."""
    both = is_null_eval(left) & is_null_eval(right)
    one = is_null_eval(left) | is_null_eval(right)
    numbers = decimal_value(left).isNotNull() & decimal_value(right).isNotNull()
    return F.when(both, True).when(one, False).when(numbers, decimal_value(left) == decimal_value(right)).otherwise(normal_text(left) == normal_text(right))


def canonical_cell(value: Column) -> Column:
    return F.when(is_null_eval(value), F.lit("")).otherwise(F.trim(value))


def join_value(value: Column) -> Column:
    """A key for joining: a normal number or lower-cased text; over 120 characters there is none."""
    text = F.lower(F.trim(value))
    as_number = F.regexp_replace(decimal_value(value).cast("string"), r"\.?0+$", "")
    return F.when(value.rlike(_WHOLE), value).when(text.isNull() | (text == "") | (F.length(text) > 120), F.lit(None)).otherwise(F.coalesce(as_number, text))


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once: written out at each use, nested rules grow beyond what compiles."""
    return F.element_at(F.transform(F.array(value), of), 1)


def membership_key(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return F.when(text != "", text)


def identifier(value: Column) -> Column:
    """Runs of other than letters and digits become one underscore; an empty result is ``unknown``."""
    text = F.lower(F.regexp_replace(F.regexp_replace(F.trim(value), "[^A-Za-z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(F.coalesce(text, F.lit("")) == "", "unknown").otherwise(text)


def satisfies(value: Column, operator: str, expected: float | str) -> Column:
    """Numbers compare as numbers; text is contained or not for = and !=, other operators are false."""
    if isinstance(expected, (int, float)):
        v, e = number(money_text(value)), F.lit(float(expected))
        tests = {"=": v == e, "!=": v != e, "<>": v != e, "<": v < e, "<=": v <= e, ">": v > e, ">=": v >= e}
        return F.coalesce(tests[operator], F.lit(False))
    inside = alnum_text(value).contains(alnum_text(F.lit(expected)))
    return inside if operator == "=" else ~inside if operator in ("!=", "<>") else F.lit(False)


def contains_value(document: Column, expected: Column) -> Column:
    needle = alnum_text(expected)
    return (needle == "") | alnum_text(document).contains(needle)


def like_contains(value: Column, pattern: str) -> Column:
    """A LIKE pattern's fixed text, wildcards as blanks, contained regardless of case."""
    return F.lower(value).contains(" ".join(pattern.replace("%", " ").replace("_", " ").split()).lower())


def excerpt(text: Column, needle: Column, most: int = 220) -> Column:
    """At most ``most`` characters around the first occurrence of the needle, or from the start."""
    at = F.locate("\x00", F.lit("x")) if needle is None else F.greatest(F.position(F.lower(needle), F.lower(text)), F.lit(1))
    return F.substring(text, F.greatest(at - most // 2, F.lit(1)), F.lit(most))


def years(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(?:19|20)\d{2}\b"), F.lit(0)), lambda y: y.cast("double"))


def json_payload(value: Column, schema: str, default: Column | None = None) -> Column:
    parsed = F.from_json(value, schema)
    return parsed if default is None else F.coalesce(parsed, default)


def serialise(value: Column) -> Column:
    return F.when(~F.coalesce(value == "None", F.lit(True)), value)


def char_chunks(text: Column, size: int, overlap: int) -> Column:
    """Array of chunks: steps of size - overlap while more than the overlap is left; an empty text is one empty chunk."""
    step = size - overlap
    if step <= 0:
        raise ValueError("the overlap is smaller than the chunk")
    text = F.coalesce(text, F.lit(""))
    last = F.greatest(F.floor((F.length(text) - overlap - 1) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * step + 1, F.lit(size)))


def token_chunks(text: Column, size: int, overlap: int) -> Column:
    """The same on blank-separated tokens, joined by single blanks."""
    step = size - overlap
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")
    last = F.greatest(F.floor((F.size(words) - overlap - 1) / step), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, F.lit(size)), " "))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In doubles; a zero vector has similarity 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, dot(a, b) / norms).otherwise(F.lit(0.0))


def safe_ratio(part: Column, whole: Column, empty: float = 0.0) -> Column:
    return F.when(whole == 0, F.lit(empty)).otherwise(part / whole)
