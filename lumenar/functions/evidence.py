"""Evidence in free text that needs context around a match: Arrow UDFs, one batch at a time."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenar.functions.values import NUMBER_WORDS, coerce_number

_NUMBER = re.compile(r"(?<![\w.])-?\$?\d+(?:,\d{3})*(?:\.\d+)?%?")
_DENIED_BEFORE = re.compile(r"\b(?:no|not|never|without|lack of)\b")

# What denies an attribute after its phrase, and the phrases that assert an attribute which is false unless the text says so.
_DENIED_AFTER = re.compile(r"^\s*(?:status|membership)?\s*[:=-]?\s*(?:no|false|0)\b")
PHRASES = {
    "dropped_in_rank": (r"\bdropped in rank\b", r"\bdrop in rank\b", r"\bdecline(?:d)? (?:of \d+ places? )?in (?:its )?rank\b", r"\bmoved down\b"),
    "gained_in_rank": (r"\bgain(?:ed)? in rank\b", r"\bimproved (?:its )?rank\b", r"\bmoved up\b", r"\brise in (?:the )?rank(?:ing)?\b", r"\bupward trajectory\b"),
    "is_profitable": (r"\bprofitable\b", r"\bprofitability\b", r"\bposted (?:a )?profit\b"),
    "growth_in_jobs": (
        r"\bgrowth in jobs\b", r"\bjob growth\b", r"\bemployment growth\b", r"\bworkforce growth\b", r"\bjob creation\b", r"\bcreated jobs?\b", r"\badding jobs?\b",
        r"\bincrease[sd]? in (?:employment|jobs|headcount|workforce)\b", r"\bexpanded (?:its )?(?:workforce|employee base|headcount)\b",
        r"\bexpanding (?:its )?(?:workforce|employee base|headcount)\b", r"\bgrowing workforce\b", r"\bworkforce expansion\b", r"\bemployment opportunities\b", r"\binvesting in human capital\b",
    ),
    "best_companies_to_work_for": (r"\bbest companies to work for\b", r"\bbest workplaces?\b"),
    "global500": (r"\bfortune global 500\b", r"\bglobal fortune 500\b", r"\bglobal 500\b"),
    "founder_is_ceo": (
        r"\bfounder and (?:the )?ceo\b", r"\bco-founder and (?:the )?ceo\b", r"\bceo and (?:co-)?founder\b",
        r"\bfounder[^.]{0,120}\b(?:serves as|is|as|currently serves as)[^.]{0,60}\bceo\b", r"\bfounded by [^.]{0,120}\b(?:serves as|is|as|currently serves as)[^.]{0,60}\bceo\b",
        r"\bchief executive[^.]{0,80}\b(?:founder|co-founder)\b",
    ),
    "is_female_ceo": (r"\bfemale ceo\b", r"\bwoman ceo\b", r"\bwoman-led\b", r"\bled by [^.]{0,80}\bfemale\b"),
    "newcomer_to_the_fortune500": (
        r"\bnewcomer to (?:the )?fortune\s*500\b", r"\bnew entrant (?:to|in) (?:the )?fortune\s*500\b", r"\bnewly entered (?:the )?fortune\s*500\b",
        r"\bmade (?:its )?debut (?:on|in) (?:the )?fortune\s*500\b", r"\bdebuted (?:on|in) (?:the )?fortune\s*500\b",
    ),
    "worlds_most_admired_companies": (r"\bworld'?s most admired companies\b", r"\bworlds most admired companies\b", r"\bmost admired companies\b"),
}
#: The numeric attribute whose sign decides, where it is known.
SIGNS = {"dropped_in_rank": ("change_in_rank", -1), "gained_in_rank": ("change_in_rank", 1), "is_profitable": ("profits_m", 1)}

# What stands around the number in question, by attribute; ``num`` is that number.
_COUNT = r"(?P<num>\d+(?:,\d{3})*|no|none|zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve)"
_AMOUNT = r"(?P<num>\d+(?:,\d{3})*(?:\.\d+)?)"
_PUPILS = r"(?:students|seniors|learners|graduates|pupils)"
_TOOK = r"(?:participated|took|take|taken|taking|undertook|opted|sat)"
_HOW = r"(?:a|an|solid|commendable|impressive|slightly|higher|lower|notably|better|strong|respectable)"
PARSERS = {
    "num_tst_takr": (
        rf"{_COUNT}\s+{_PUPILS}?\s*(?:who\s+)?(?:have\s+|had\s+)?{_TOOK}\b[^.]*\b(?:sat|test)",
        rf"{_COUNT}\s+of\s+(?:these\s+)?{_PUPILS}\s+(?:have\s+|had\s+)?{_TOOK}\b[^.]*\b(?:sat|test)",
        rf"a total of\s+{_COUNT}\s+{_PUPILS}\s+(?:have\s+|had\s+)?{_TOOK}\b[^.]*\b(?:sat|test)",
        rf"\bsat[^.]*?(?:taken|took|participated)\s+by\s+{_COUNT}\s+{_PUPILS}",
    ),
    "num_ge1500": (
        rf"{_COUNT}\s+{_PUPILS}?[^.]*?(?:scored|achieved|surpassed|surpassing)[^.]*?(?:above|over|more than|exceeding)\s+1500",
        rf"{_COUNT}\s+{_PUPILS}?[^.]*?1500",
        rf"(?:above|over|more than|exceeding)\s+1500[^.]*?{_COUNT}\s+{_PUPILS}",
    ),
    "height": (
        rf"\bheight\s+(?:of|at|is|was)\s+{_AMOUNT}\s+(?:centimeters|centimetres|cm)\b",
        rf"\b(?:standing|stands|stood)\s+(?:tall\s+)?(?:at\s+)?(?:(?:an?|the)\s+)?(?:impressive|sturdy|notable|remarkable)?\s*(?:height\s+of\s+)?{_AMOUNT}\s+(?:centimeters|centimetres|cm)\b",
    ),
    "weight": (
        rf"\bweighing\s+in\s+at\s+{_AMOUNT}\s+(?:pounds|lbs?|lb)\b",
        rf"\bweighing\s+{_AMOUNT}\s+(?:pounds|lbs?|lb)\b",
        rf"\bweighs\s+(?:in\s+)?(?:at\s+)?{_AMOUNT}\s+(?:pounds|lbs?|lb)\b",
        rf"\bweight\s+(?:of|at|is|was)\s+{_AMOUNT}\s+(?:pounds|lbs?|lb)\b",
        rf"\bat\s+(?:(?:an?|the)\s+)?(?:sturdy|solid|listed|recorded)?\s*weight\s+of\s+{_AMOUNT}\s+(?:pounds|lbs?|lb)\b",
    ),
    "overall_rating": (
        rf"\boverall\s+(?:performance\s+)?rating\s+(?:of|at|is|was|to)?\s+{_AMOUNT}\b",
        rf"\breceived\s+an?\s+overall\s+(?:performance\s+)?rating\s+of\s+{_AMOUNT}\b",
        rf"\brecorded\s+with\s+an?\s+overall\s+(?:performance\s+)?rating\s+of\s+{_AMOUNT}\b",
    ),
    "potential": (
        rf"\bpotential\s+rating\s+(?:of|at|is|was|soaring\s+to)?\s+{_AMOUNT}\b",
        rf"\bpotential\s+to\s+reach\s+(?:an?\s+)?(?:impressive\s+)?(?:future\s+)?(?:score|rating)\s+of\s+{_AMOUNT}\b",
    ),
    "aggression": (
        rf"\baggression\s+level\s+(?:of|at|is|was)?\s+{_AMOUNT}\b",
        rf"\blevel\s+of\s+aggression\s+(?:rated\s+)?(?:of|at|is|was)?\s+{_AMOUNT}\b",
        rf"\baggression\s*,?\s+standing\s+at\s+{_AMOUNT}\b",
        rf"\baggression\s*\(\s*{_AMOUNT}\s*\)",
        rf"\baggression\s+rated\s+(?:of|at)?\s+{_AMOUNT}\b",
    ),
    "year": (r"\b(?P<num>(?:19|20)\d{2})\b",),
}
#: The words for each average score, and what stands around it: TERM is one of them.
SCORES = {"avg_scr_math": ("math", "mathematics"), "avg_scr_read": ("reading", "read"), "avg_scr_write": ("writing", "write")}
AVERAGE_OF_TERM = (
    rf"(?:average\s+)?TERM\s+(?:score|average)\s*(?:was|is|of|at|reached|sitting at|stood at|slightly higher at|lower at)?\s*(?:{_HOW}\s+)*{_AMOUNT}",
    rf"TERM\s+(?:reaching\s+an\s+average\s+of|at)\s*(?:{_HOW}\s+)*{_AMOUNT}",
    rf"TERM\s+averag(?:e|ing|ed)\s*(?:score\s*)?(?:of|was|at|reached|to)?\s*(?:{_HOW}\s+)*{_AMOUNT}",
    rf"TERM\s*,?[^.;]{{0,80}}?\b(?:average(?:d)?|score)\b[^.;]{{0,45}}?\b(?:of|was|at|reached|with a score of|to)?\s*(?:{_HOW}\s+)*{_AMOUNT}",
    rf"\b(?:average\s+scores?|average)\b[^.;]{{0,90}}?{_AMOUNT}\s+in\s+TERM\b",
)
#: That nobody, or a quarter of those counted before, reached 1500.
NOBODY_OVER_1500 = rf"\b(?:no|none)\s+{_PUPILS}?[^.]*?(?:scored|achieved)[^.]*?(?:above|over|more than|exceeding)\s+1500"
QUARTER_OVER_1500 = r"\ba quarter of (?:these|the)\s+(?:test-takers|students|seniors|learners|graduates|pupils)[^.]*?(?:scored|achieved|excelled)[^.]*?1500"


def number_of(token: str) -> float | None:
    token = token.strip().lower()
    if token in NUMBER_WORDS:
        return float(NUMBER_WORDS[token])
    try:
        value = float(token.replace(",", "").replace("$", "").replace("%", ""))
    except ValueError:
        return None
    return value if np.isfinite(value) else None


def denied(text: str, start: int, end: int) -> bool:
    return bool(_DENIED_BEFORE.search(text[max(0, start - 80) : start].lower()) or _DENIED_AFTER.search(text[end : end + 50].lower()))


def asserts(text: str | None, patterns: tuple[str, ...]) -> bool:
    """Some pattern occurs without being denied."""
    text = text or ""
    return any(not denied(text, m.start(), m.end()) for p in patterns for m in re.finditer(p, text, re.IGNORECASE))


def has_phrase(text: Column, attribute: str) -> Column:
    patterns = PHRASES[attribute]

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: asserts(t, patterns)).astype(bool)

    return run(text)


def closed_world_boolean(attribute: str, text: Column, signal: Column | None = None) -> Column:
    """``1`` or ``0``: by the sign of a known number, else by the phrases; attributes without phrases are ``0``."""
    if attribute not in PHRASES:
        return F.lit("0")
    told = F.when(has_phrase(text, attribute), "1").otherwise("0")
    if signal is None or attribute not in SIGNS:
        return told
    return F.when(signal.isNotNull(), F.when(signal * SIGNS[attribute][1] > 0, "1").otherwise("0")).otherwise(told)


#: Words that stand for attributes whose names are none.
HINTS = {
    "avg_scr_math": ["average", "math", "score"],
    "avg_scr_read": ["average", "reading", "read", "score"],
    "avg_scr_write": ["average", "writing", "write", "score"],
    "num_tst_takr": ["test", "took", "taken", "takers"],
    "num_ge1500": ["1500", "above", "scored"],
    "credits": ["credit", "credits"],
    "semester": ["semester"],
    "year": ["year"],
    "salary": ["salary", "earns", "earning", "$"],
}


def hints_of(attribute: str) -> list[str]:
    """Words near which an attribute's numbers stand: known ones, else the words of its name."""
    name = attribute.lower()
    return HINTS[name] if name in HINTS else [part for part in re.split(r"[_\W]+", name) if part]


def numbers_near(text: str | None, attribute: str, radius: int = 90) -> list[float]:
    """Numbers with one of the attribute's words within ``radius`` characters, all of them where it has none; digits of its own name don't count."""
    text, hints = (text or "").lower(), hints_of(attribute)
    own = {number_of(t) for t in re.findall(r"\d+(?:\.\d+)?", attribute)}
    found = []
    for m in _NUMBER.finditer(text):
        window = text[max(0, m.start() - radius) : m.end() + radius]
        value = number_of(m.group())
        if value is not None and value not in own and (not hints or any(h in window for h in hints)):
            found.append(value)
    return found


def nearby_numbers(text: Column, attribute: str, radius: int = 90) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: numbers_near(t, attribute, radius))

    return run(text)


#: An extension: phrasings with a unit that are looked for where the patterns above find nothing, if asked.
COMMON = {"height": (rf"{_AMOUNT}\s*(?:centimeters|centimetres|cm)\b",), "weight": (rf"{_AMOUNT}\s*(?:pounds|lbs?)\b",)}


def _matched(text: str, patterns: tuple[str, ...]) -> list[float]:
    tokens = [m.group("num") for p in patterns for m in re.finditer(p, text)]
    return [v for v in map(number_of, tokens) if v is not None]


def _quarters(text: str) -> list[float]:
    """A quarter of the test takers counted last before each mention, else of the last number in the 120 characters before it."""
    found = []
    for m in re.finditer(QUARTER_OVER_1500, text):
        counted = _matched(text[: m.start()], PARSERS["num_tst_takr"])
        if not counted:
            near = [number_of(n.group()) for n in _NUMBER.finditer(text[max(0, m.start() - 120) : m.start()])]
            counted = [n for n in near if n is not None]
        found += [counted[-1] / 4] if counted else []
    return found


def parsed_numbers(text: str | None, attribute: str, common: bool = True) -> list[float]:
    """Numbers that the attribute's own parser finds, pattern by pattern; attributes without one have none."""
    text, attribute = (text or "").lower(), attribute.lower()
    if attribute in SCORES:
        return [v for term in SCORES[attribute] for v in _matched(text, tuple(p.replace("TERM", term) for p in AVERAGE_OF_TERM))]
    found = _matched(text, PARSERS.get(attribute, ()))
    if attribute == "num_ge1500":
        found += [0.0] if re.search(NOBODY_OVER_1500, text) else []
        found += _quarters(text)
    return found if found or not common else _matched(text, COMMON.get(attribute, ()))


def has_parser(attribute: str) -> bool:
    return attribute.lower() in PARSERS or attribute.lower() in SCORES


def row_id_numbers(source_row_id: Column, row_id: Column, parent_doc_id: Column) -> Column:
    """The numbers by which a document names its row: its row ids, and what follows the last dash of its parent's id."""
    suffix = F.element_at(F.split(parent_doc_id.cast("string"), "-"), -1)
    return F.filter(F.transform(F.array(source_row_id.cast("string"), row_id.cast("string"), suffix), coerce_number), lambda x: x.isNotNull())


def loosely_equal(left: str | None, right: str | None) -> bool:
    """Equal as JSON values, else as texts of one Unicode form without case and outer blanks."""
    if left is None or right is None:
        return left is right
    try:
        if json.loads(left) == json.loads(right):
            return True
    except (ValueError, RecursionError):
        pass
    plain = [unicodedata.normalize("NFKC", x).strip().lower() for x in (left, right)]
    return plain[0] == plain[1]


def span_of_tokens(span: list[int], tokens: list[int], taken: tuple[tuple[int, int], ...] = ()) -> tuple[int, int] | None:
    """The first place (start, end) of a run of token ids that overlaps no taken one."""
    n = len(span)
    for at in range(len(tokens) - n + 1) if n else ():
        if tokens[at : at + n] == span and all(at + n <= a or at >= b for a, b in taken):
            return at, at + n
    return None


def span_of_text(text: str, pieces: list[str], taken: tuple[tuple[int, int], ...] = ()) -> tuple[int, int] | None:
    """The first run of pieces whose letters and digits, joined, are the text's; it overlaps no taken one."""
    letters = lambda x: re.sub(r"[\W_]+", "", unicodedata.normalize("NFKC", x)).lower()
    wanted, plain = letters(text), [letters(p) for p in pieces]
    for at in range(len(plain)):
        joined = ""
        for end in range(at, len(plain)):
            joined += plain[end]
            if not wanted.startswith(joined):
                break
            if wanted and joined == wanted and plain[at]:
                if all(end + 1 <= a or at >= b for a, b in taken):
                    return at, end + 1
                break
    return None


def explicit_numbers(text: Column, attribute: str) -> Column:
    """``parsed_numbers`` by the fixed patterns alone."""

    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: parsed_numbers(t, attribute, common=False))

    return run(text)


@lru_cache(maxsize=1 << 16)
def _hashed(token: str) -> int:
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")


def _hash_vector(text: str | None, dimensions: int) -> np.ndarray:
    raw = np.fromiter(map(_hashed, re.findall(r"[a-z0-9_]+", (text or "").lower())), np.uint64)
    signs = ((raw >> np.uint64(8)) & np.uint64(1)).astype(np.float64) * 2 - 1
    vector = np.bincount((raw % np.uint64(dimensions)).astype(np.int64), weights=signs, minlength=dimensions)
    norm = np.linalg.norm(vector)
    return vector / norm if norm else vector


def hash_embed(text: str | None, dimensions: int = 256) -> list[float]:
    """Signed counts of hashed tokens, of unit length; all zeros without tokens, or where they cancel out."""
    return _hash_vector(text, dimensions).tolist()


def hash_embedding(text: Column, dimensions: int = 256) -> Column:
    @F.arrow_udf("array<double>")
    def run(texts: pa.Array) -> pa.Array:
        flat = np.empty(len(texts) * dimensions)  # one buffer: a batch of lists or of arrays takes many times the memory
        for i, t in enumerate(texts):
            flat[i * dimensions : (i + 1) * dimensions] = _hash_vector(t.as_py(), dimensions)
        return pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, dimensions, np.int32), pa.array(flat))

    return run(text)


# Where a company's text tells its updated market value and its ticker.
MARKET_VALUE = (
    r"(?i)(?:updated figures? of|updated (?:market )?(?:cap(?:italization)?|value) of)\s*(?:approximately\s*)?\$?([\d,]+(?:\.\d+)?)\s*(billion|million|m|bn)?",
    r"(?i)(?:market (?:cap(?:italization)?|value)[^.]{0,120}?as of June 4, 2024[^$0-9]{0,40})\$?([\d,]+(?:\.\d+)?)\s*(billion|million|m|bn)?",
    r"(?i)\$?([\d,]+(?:\.\d+)?)\s*(billion|million|m|bn)?[^.]{0,80}as of June 4, 2024",
    r"(?i)(?:minor increase|slight adjustment|adjustment|increase|update)\s+to\s+\$?([\d,]+(?:\.\d+)?)\s*(billion|million|m|bn)?[^.]{0,80}\bupdated figures?\b",
    r"(?i)\$?([\d,]+(?:\.\d+)?)\s*(billion|million|m|bn)?[^.]{0,80}\bupdated figures?\b",
)
TICKER = (
    r"\bticker symbol\s*(?:of|is|:)?\s*[\"']?([A-Z][A-Z0-9.\-]{0,9})[\"']?\b",
    r"\b(?:NYSE|Nasdaq|NASDAQ)\s+ticker\s*[:=-]?\s*([A-Z][A-Z0-9.\-]{0,9})\b",
    r"\b(?:listed|operates|traded) under (?:the )?ticker(?: symbol)?\s*[\"']?([A-Z][A-Z0-9.\-]{0,9})[\"']?\b",
    r"\btraded under (?:the )?symbol\s*[\"']?([A-Z][A-Z0-9.\-]{0,9})[\"']?\b",
)


def market_value_millions(text: Column) -> Column:
    """The amount of the first pattern that tells one, billions as thousands of millions."""
    found = []
    for p in MARKET_VALUE:
        amount = F.regexp_replace(F.regexp_extract(text, p, 1), ",", "").try_cast("double")
        found.append(F.when(F.lower(F.regexp_extract(text, p, 2)).isin("billion", "bn"), amount * 1000).otherwise(amount))
    return F.coalesce(*found)


def market_value_text(text: Column) -> Column:
    """``market_value_millions`` as a cell: whole amounts without a fraction."""
    amount = market_value_millions(text)
    return F.when(amount == F.floor(amount), amount.cast("decimal(38,0)").cast("string")).otherwise(amount.cast("string"))


def ticker(text: Column) -> Column:
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in TICKER]
    return F.regexp_replace(F.coalesce(*found), r"[.,;:)]+$", "")
