"""Analysis of a query's text: predicates that are safe to apply early, table references, join graph, table order.

The text is cut into tokens first, so operators and keywords inside literals or quoted
names never count. Everything here is driver-side and small.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^']|'')*')|(?P<name>"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]|[^\W\d]\w*)"""
    r"""|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<op><=|>=|<>|!=|=|<|>)|(?P<mark>[(),.;*+/%-]))""",
    re.UNICODE,
)
_ENDS = {"GROUP", "ORDER", "HAVING", "LIMIT", "UNION", "INTERSECT", "EXCEPT", ";"}
_SETS = {"UNION", "INTERSECT", "EXCEPT"}
_JOIN_WORDS = {"JOIN", "INNER", "LEFT", "RIGHT", "FULL", "CROSS", "OUTER", "NATURAL"}


@dataclass(frozen=True)
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind in ("name", "mark", "op") and self.text[:1] not in "\"`[" else ""

    @property
    def name(self) -> str:
        if self.text[:1] in "\"`[":
            closing = {"[": "]"}.get(self.text[0], self.text[0])
            return self.text[1:-1].replace(closing * 2, closing)
        return self.text


def tokens(sql: str) -> list[Token]:
    found, at = [], 0
    sql = sql.rstrip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        if not m or m.end() == at:
            raise ValueError(f"cannot read SQL at: {sql[at : at + 20]!r}")
        found.append(Token(m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return found


@dataclass(frozen=True)
class Predicate:
    attribute: str
    operator: str
    value: Any
    alias: str | None = None
    value_is_column: bool = False

    @property
    def is_numeric(self) -> bool:
        return isinstance(self.value, (int, float)) and not isinstance(self.value, bool)


@dataclass
class Join:
    parent: tuple[str, str]
    child: tuple[str, str]


@dataclass
class Analysis:
    tables: list[str] = field(default_factory=list)  # in order of FROM
    aliases: dict[str, str] = field(default_factory=dict)
    safe: dict[str, list[Predicate]] = field(default_factory=dict)
    unsafe: list[tuple[str, str]] = field(default_factory=list)  # (text, reason)
    joins: list[Join] = field(default_factory=list)
    set_operation: bool = False


def _depths(items: list[Token]) -> list[int]:
    depth, out = 0, []
    for t in items:
        depth -= t.text == ")" and t.kind == "mark"
        out.append(depth)
        depth += t.text == "(" and t.kind == "mark"
    return out


def _clause(items: list[Token], word: str) -> list[Token]:
    """Tokens of the first top-level clause that opens with ``word``."""
    depth = _depths(items)
    start = next((i for i, t in enumerate(items) if t.word == word and depth[i] == 0), None)
    if start is None:
        return []
    stops = _ENDS | ({"WHERE"} if word == "FROM" else set())
    end = next((i for i in range(start + 1, len(items)) if depth[i] == 0 and items[i].word in stops), len(items))
    return items[start + 1 : end]


def _split(items: list[Token], word: str) -> list[list[Token]]:
    """Cut at top-level ``word``; the AND of a BETWEEN does not cut."""
    parts, current, between = [], [], False
    for t, depth in zip(items, _depths(items), strict=True):
        if depth == 0 and t.word == "BETWEEN":
            between = True
        if depth == 0 and t.word == word and not (between and word == "AND"):
            parts.append(current)
            current = []
            continue
        if depth == 0 and t.word == "AND":
            between = False
        current.append(t)
    return [p for p in [*parts, current] if p]


def _unwrap(items: list[Token]) -> list[Token]:
    """Without outer brackets."""
    while len(items) > 1 and items[0].text == "(" and items[-1].text == ")" and all(d > 0 for d in _depths(items)[1:-1]):
        items = items[1:-1]
    return items


def column_of(items: list[Token]) -> tuple[str | None, str] | None:
    """(alias, column) of a column in brackets, CAST, LOWER, UPPER or TRIM; None for other expressions."""
    items = _unwrap(items)
    if len(items) > 3 and items[0].word in ("CAST", "LOWER", "UPPER", "TRIM") and items[1].text == "(" and items[-1].text == ")":
        inner = items[2:-1]
        return column_of(_split(inner, "AS")[0] if items[0].word == "CAST" else inner)
    names = items[::2]
    if not items or len(items) % 2 == 0 or any(t.text != "." for t in items[1::2]) or any(t.kind != "name" for t in names):
        return None
    return (names[-2].name if len(names) > 1 else None), names[-1].name


def _literal(items: list[Token]) -> tuple[bool, Any]:
    """(is a literal, value)."""
    items = _unwrap(items)
    sign = -1 if items and items[0].text == "-" else 1
    rest = items[1:] if items and items[0].text in "+-" and items[0].kind == "mark" else items
    if len(rest) != 1:
        return False, None
    t = rest[0]
    if t.kind == "number":
        return True, sign * (float(t.text) if re.search(r"[.eE]", t.text) else int(t.text))
    if t.kind == "string":
        return True, t.text[1:-1].replace("''", "'")
    if t.kind == "name" and t.text[0] == '"':
        return True, t.name  # a double-quoted literal
    return (True, None) if t.word == "NULL" else (False, None)


def parse_condition(items: list[Token]) -> Predicate | None:
    items = _unwrap(items)
    depth = _depths(items)
    at = next((i for i, t in enumerate(items) if depth[i] == 0 and (t.kind == "op" or t.word in ("IS", "NOT", "LIKE", "IN", "BETWEEN"))), None)
    if not at:
        return None
    left = column_of(items[:at])
    if left is None:
        return None
    alias, attribute = left
    words = [t.word for t in items[at:]]
    if words[:3] == ["IS", "NOT", "NULL"]:
        return Predicate(attribute, "IS NOT NULL", None, alias)
    if words[:2] == ["IS", "NULL"]:
        return Predicate(attribute, "IS NULL", None, alias)
    negated = words[0] == "NOT"
    operator = words[negated]
    right = items[at + negated + 1 :]
    name = f"NOT {operator}" if negated else operator
    if operator == "LIKE":
        known, value = _literal(right)
        return Predicate(attribute, name, value, alias) if known else None
    if operator == "IN":
        values = [_literal(part) for part in _split_commas(_unwrap(right))]
        return Predicate(attribute, name, [v for _, v in values], alias) if values and all(k for k, _ in values) else None
    if operator == "BETWEEN":
        ends = [_literal(p) for p in _split(right, "AND")]
        return Predicate(attribute, name, [v for _, v in ends], alias) if len(ends) == 2 and all(k for k, _ in ends) and not negated else None
    if negated or items[at].kind != "op":
        return None
    known, value = _literal(right)
    if known:
        return Predicate(attribute, operator, value, alias)
    other = column_of(right)
    return Predicate(attribute, operator, ".".join(x for x in other if x), alias, True) if other else None


def _split_commas(items: list[Token]) -> list[list[Token]]:
    parts, current = [], []
    for t, depth in zip(items, _depths(items), strict=True):
        if t.text == "," and depth == 0 and t.kind == "mark":
            parts.append(current)
            current = []
        else:
            current.append(t)
    return [p for p in [*parts, current] if p]


def has_set_operation(sql: str) -> bool:
    return any(t.word in _SETS for t in tokens(sql))


def has_join(sql: str) -> bool:
    return any(t.word == "JOIN" for t in tokens(sql))


def predicates(sql: str) -> list[Predicate]:
    """One for each top-level conjunct of WHERE that is a plain comparison."""
    return [p for part in _split(_clause(tokens(sql), "WHERE"), "AND") if (p := parse_condition(part))]


def table_references(sql: str) -> tuple[list[tuple[str, str]], list[list[Token]]]:
    """[(table, alias)] in order and the ON conditions."""
    items = _clause(tokens(sql), "FROM")
    refs, conditions, current, mode = [], [], [], "table"
    for t, depth in zip([*items, Token("mark", ",")], [*_depths(items), 0], strict=True):
        if depth == 0 and (t.word in _JOIN_WORDS or (t.text == "," and t.kind == "mark")):
            if current and mode == "table":
                refs.append(_reference(current))
            elif current and mode == "on":
                conditions.append(current)
            current, mode = [], "table"
        elif depth == 0 and t.word in ("ON", "USING"):
            refs.append(_reference(current))
            current, mode = [], t.word.lower()
        else:
            current.append(t)
    return [r for r in refs if r], conditions


def _reference(items: list[Token]) -> tuple[str, str] | None:
    items = [t for t in items if t.word != "AS"]
    if not items or items[0].kind != "name":
        return None
    last = 0
    while last + 2 < len(items) and items[last + 1].text == ".":
        last += 2
    table = items[last].name
    return table, (items[last + 1].name if last + 1 < len(items) and items[last + 1].kind == "name" else table)


def alias_map(sql: str) -> dict[str, str]:
    refs, _ = table_references(sql)
    return {alias: table for table, alias in refs} | {table: table for table, _ in refs}


def _text(items: list[Token]) -> str:
    return " ".join(t.text for t in items)


def owner(p: Predicate, aliases: dict[str, str], schema: dict[str, list[str]], tables: list[str]) -> str | None:
    """The table of a predicate: by alias, else its only owner in the schema, else the first of the query's tables that owns it."""
    if p.alias:
        return aliases.get(p.alias)
    owning = [t for t in schema if p.attribute in schema[t]]
    inside = [t for t in tables if t in owning]
    return owning[0] if len(owning) == 1 else inside[0] if inside else tables[0] if len(tables) == 1 else None


def analyse(sql: str, schema: dict[str, list[str]] | None = None) -> Analysis:
    """Which conjuncts may be applied to single rows before the joins, and how the tables join.

    Unsafe: any predicate of a query with a set operation, subqueries, OR, comparisons of two
    columns, and whatever is no plain comparison.
    """
    schema = schema or {}
    items = tokens(sql)
    refs, conditions = table_references(sql)
    out = Analysis([t for t, _ in refs], alias_map(sql), set_operation=any(t.word in _SETS for t in items))
    for part in _split(_clause(items, "WHERE"), "AND"):
        words = {t.word for t in part}
        p = None if "SELECT" in words or "OR" in words else parse_condition(part)
        reason = (
            "set operation" if out.set_operation else "subquery" if "SELECT" in words else "disjunction" if "OR" in words
            else "no plain comparison" if p is None else "compares columns" if p.value_is_column else None
        )
        table = owner(p, out.aliases, schema, out.tables) if p and not reason else None
        if reason or table is None:
            out.unsafe.append((_text(part), reason or "no table owns it"))
        else:
            out.safe.setdefault(table, []).append(p)
    position = {t: i for i, t in reversed(list(enumerate(out.tables)))}
    for condition in conditions:
        for part in _split(condition, "AND"):
            p = parse_condition(part)
            if not p or not p.value_is_column or p.operator != "=" or not p.alias or "." not in p.value:
                continue
            other_alias, other = p.value.split(".")[-2:]
            ends = [(out.aliases.get(p.alias), p.attribute), (out.aliases.get(other_alias), other)]
            if all(t in position for t, _ in ends):
                ends.sort(key=lambda e: position[e[0]])  # the earlier table is the parent
                out.joins.append(Join(ends[0], ends[1]))
    return out


def table_order(analysis: Analysis, selective_first: bool = False) -> list[str]:
    """Parents before children, ties and cycles in order of the query; or most predicates first."""
    tables = list(dict.fromkeys(analysis.tables))
    if selective_first:
        return sorted(tables, key=lambda t: -len(analysis.safe.get(t, [])))
    parents = {t: {j.parent[0] for j in analysis.joins if j.child[0] == t and j.parent[0] != t} for t in tables}
    done: list[str] = []
    while len(done) < len(tables):
        rest = [t for t in tables if t not in done]
        done.append(next((t for t in rest if parents[t] <= set(done)), rest[0]))
    return done


def joined_order(analysis: Analysis) -> list[str]:
    """Most predicates first, and after that tables that join one already taken, so that what a table rejects is known wherever it reaches."""
    rest = table_order(analysis, selective_first=True)
    done: list[str] = []
    while rest:
        met = {t for j in analysis.joins for t in (j.parent[0], j.child[0]) if j.parent[0] in done or j.child[0] in done}
        done.append(next((t for t in rest if t in met), rest[0]))
        rest.remove(done[-1])
    return done


def joined_tables(analysis: Analysis, table: str) -> set[str]:
    """The tables that joins connect with ``table``, itself included."""
    out, last = {table}, set()
    while out != last:
        last = set(out)
        for j in analysis.joins:
            if {j.parent[0], j.child[0]} & out:
                out |= {j.parent[0], j.child[0]}
    return out


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'
