"""Fill-in-the-middle transformation by escaped marker injection (DataFrame functions only).

A delimiter is escaped out of the text, ``regexp_replace`` appends it after every unit, its
occurrences are the number of units, ``substring_index`` extracts the parts between ranked
occurrences, and the parts are stripped of delimiters, unescaped and assembled:

* psm: ``<P>`` prefix ``<S>`` suffix ``<M>`` middle
* spm: ``<S>`` suffix ``<P>`` prefix ``<M>`` middle
* plain: the text as it is

Cuts and forms are drawn from the hex SHA-256 of ``seed:id``, so they depend on no order,
partition or attempt. Nothing is shuffled: each row is one expression.

Defined results: null texts are empty; empty texts and those that hold one of the three markers
are plain, so an output can always be taken apart again; rows with a null id have no hash and are
plain; texts of any length are cut whole (marked copies of a text take up to three times its
size while its row is worked on); rows that repeat an id get the same fractions; ties cannot
occur; an empty table gives no rows; further columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.storage import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: After escaping, DELIMITER occurs nowhere in a text and ESCAPE only before D or E.
DELIMITER, ESCAPE = "\u001e", "\u001d"
_DELIMITER_ESCAPED, _ESCAPE_ESCAPED = ESCAPE + "D", ESCAPE + "E"
#: What a unit is, as a pattern over escaped texts that matches them from end to end.
UNITS = {
    "character": f"{ESCAPE}[DE]|[^{ESCAPE}]",
    "word": r"\S+\s*|\s+",
    "line": r"[^\n]*\n|[^\n]+",
}


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(_ESCAPE_ESCAPED)), F.lit(DELIMITER), F.lit(_DELIMITER_ESCAPED))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(_DELIMITER_ESCAPED), F.lit(DELIMITER)), F.lit(_ESCAPE_ESCAPED), F.lit(ESCAPE))


def marked(text: Column, unit: str = "character") -> Column:
    """The escaped text with the delimiter after every unit."""
    return F.regexp_replace(escaped(text), f"({UNITS[unit]})", "$1" + DELIMITER)


def unit_count(marks: Column) -> Column:
    return (F.length(marks) - F.length(F.replace(marks, F.lit(DELIMITER), F.lit("")))).cast("long")


def units_between(marks: Column, first: Column, last: Column, count: Column) -> Column:
    """The text of the units after the ``first`` up to the ``last`` (0 to ``count``)."""
    delimiter = F.lit(DELIMITER)
    head = F.when(last >= count, marks).otherwise(F.call_function("substring_index", marks, delimiter, last.cast("int")))
    # a whole text ends with a delimiter, a head does not
    back = F.when(last >= count, count + 1).otherwise(last) - first
    tail = F.when(first >= last, F.lit("")).when(first <= 0, head).otherwise(F.call_function("substring_index", head, delimiter, (-back).cast("int")))
    return unescaped(F.replace(tail, delimiter, F.lit("")))


def _draw(digest: Column, k: int) -> Column:
    """The k-th group of eight hex digits as a number."""
    return F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("long")


def assembled(form: Column, text: Column, prefix: Column, middle: Column, suffix: Column) -> Column:
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def restored(form: Column, output: Column) -> Column:
    """The text from form and output alone: each marker occurs once, since no text that is cut holds one."""

    def between(left: str, right: str) -> Column:
        return F.substring_index(F.substring_index(output, left, -1), right, 1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, seed: int = 1, percent: int = 90, spm_percent: int = 20, unit: str = "character", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text, n, form, prefix_units, middle_units, output of every row; ``percent`` of the texts are cut, ``spm_percent`` of them with the suffix first."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = rows.select("id", "text", marked(F.col("text"), unit).alias("marks"), digest.alias("digest"))
    rows = rows.select("id", "text", "marks", unit_count(F.col("marks")).alias("n"), *(_draw(F.col("digest"), k).alias(f"h{k}") for k in (1, 2, 3, 4)))
    text, n = F.col("text"), F.col("n")
    plain = (text == "") | F.col("h3").isNull() | (F.col("h3") % 100 >= percent)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | text.contains(marker)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_percent, "spm").otherwise("psm")
    one, two = F.col("h1") % (n + 1), F.col("h2") % (n + 1)
    rows = rows.select("id", "text", "marks", "n", form.alias("form"), F.least(one, two).alias("a"), F.greatest(one, two).alias("b"))
    cut = F.col("form") != "plain"
    marks, a, b = F.col("marks"), F.col("a"), F.col("b")
    parts = (units_between(marks, F.lit(0).cast("long"), a, n), units_between(marks, a, b, n), units_between(marks, b, n, n))
    output = assembled(F.col("form"), text, *parts)
    return rows.select("id", "text", "n", "form", F.when(cut, a).alias("prefix_units"), F.when(cut, b - a).alias("middle_units"), output.alias("output"))


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n",
        "form",
        F.col("prefix_units").alias("prefix_chars"),
        F.col("middle_units").alias("middle_chars"),
        _sha(F.col("output")).alias("output_sha256"),
        _sha(restored(F.col("form"), F.col("output"))).alias("restored_sha256"),
    )


#: The same rows by substrings at code points; the text is rebuilt from its parts.
ORACLE = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT *, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
             ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 IS NULL OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE text END) AS output_sha256,
       sha256(CASE WHEN form = 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""
