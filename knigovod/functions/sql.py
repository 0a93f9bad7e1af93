"""Expressions as SQL text.

The field rules are long: written with Column objects, each of their thousands of operations is a call
into the JVM, which costs a streaming job seconds per micro-batch. As text a whole field is parsed at
once. Functions here take and return SQL text; `F.expr` turns the result into a column.
"""

from __future__ import annotations

from itertools import count

_numbers = count()


def quoted(text: str) -> str:
    """String literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def rx(pattern: str) -> str:
    """Case-insensitive, with Unicode letter case, blanks and word borders."""
    return "(?iU)" + pattern


def fresh(stem: str = "v") -> str:
    return f"{stem}{next(_numbers)}"


def let(value: str, body) -> str:
    """Evaluate `value` once and hand it to `body`; lazy inside coalesce() and CASE."""
    v = fresh()
    return f"get(transform(array({value}), {v} -> {body(v)}), 0)"


def when(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def coalesce(*values: str) -> str:
    return f"coalesce({', '.join(values)})"


def all_of(*conditions: str) -> str:
    return "(" + " AND ".join(conditions) + ")"


def nonblank(text: str) -> str:
    """The text, null if it is empty. (nullif() would evaluate it twice.)"""
    v = fresh()
    return f"get(filter(array({text}), {v} -> {v} <> ''), 0)"


def strip(text: str) -> str:
    return f"btrim({text}, ' \\t\\r\\n\\u000b\\u000c\\u00a0')"


def matches(text: str, pattern: str) -> str:
    """Whether the text holds a pattern, whatever the letter case."""
    return f"({text} rlike {quoted(rx(pattern))})"


def fits(text: str, pattern: str) -> str:
    """Whether the text holds a pattern, as it is written."""
    return f"({text} rlike {quoted(pattern)})"


def found(text: str, pattern: str, group: int = 1) -> str:
    """First hit of a pattern, null if there is none."""
    return nonblank(f"regexp_extract({text}, {quoted(rx(pattern))}, {group})")


def folded(text: str, lines: str) -> str:
    """A text and its lines with letter case folded as patterns fold it: where a pattern that ignores case matches, the
    folded words it is made of occur here."""
    whole = let(f"array_join({lines}, '\\n')", lambda j: (
        f"CASE WHEN {j} <=> {text} THEN {text} ELSE concat_ws('\\n', {text}, {j}) END"))
    # Folding whole texts makes two characters of this letter, a pattern takes it for a plain i. The line break keeps the
    # optimizer from leaving upper() out, without which some letters, like the long s, stay what they are.
    return f"lower(concat(upper(replace({whole}, 'İ', 'i')), '\\n'))"


def holds(folded_text: str, *words: str) -> str:
    """Whether one of the words (lower case) occurs in a folded text: a search of bytes, which spares the patterns that need one."""
    return "(" + " OR ".join(f"contains({folded_text}, {quoted(w)})" for w in words) + ")"


def all_found(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract_all({text}, {quoted(rx(pattern))}, {group})"


def transform(values: str, body) -> str:
    v = fresh()
    return f"transform({values}, {v} -> {body(v)})"


def keep(values: str, test) -> str:
    v = fresh()
    return f"filter({values}, {v} -> {test(v)})"


def first_kept(values: str, test) -> str:
    return f"get({keep(values, test)}, 0)"


def first_hit(values: str, body, result: str = "string") -> str:
    """First value of `body` over the elements that is not null. Elements behind it are not looked at."""
    found_so_far, v = fresh("f"), fresh()
    return f"aggregate({values}, CAST(NULL AS {result}), ({found_so_far}, {v}) -> coalesce({found_so_far}, {body(v)}))"


def indexes(values: str) -> str:
    """0-based indexes of an array."""
    return f"CASE WHEN size({values}) > 0 THEN sequence(0, size({values}) - 1) ELSE array() END"


def _bound(values: str, body) -> str:
    """Body over an array that is computed once."""
    return body(values) if values.isidentifier() else let(values, body)


def first_line(lines: str, body, result: str = "string") -> str:
    """`first_hit` over lines, with the index of each."""
    return _bound(lines, lambda ls: first_hit(indexes(ls), lambda i: let(f"{ls}[{i}]", lambda l: body(l, i)), result))


def index_of(lines: str, test, after: str = "-1") -> str:
    """0-based index of the first line beyond `after` that passes the test, null if none."""
    return _bound(lines, lambda ls: first_hit(
        indexes(ls), lambda i: when(all_of(f"{i} > {after}", test(f"{ls}[{i}]", i)), i), "int"))


def escape_regex(text: str) -> str:
    return f"regexp_replace({text}, {quoted(r'([^\p{L}\p{N}_])')}, {quoted(r'\\$1')})"


# --- Amounts -------------------------------------------------------------------------------------------

# Wide enough for every number a document may hold; records narrow it to two decimals.
PARSED = "decimal(24,8)"


def _number(text: str) -> str:
    return f"try_cast(rtrim('.', {text}) AS {PARSED})"


def parse_amount(text: str) -> str:
    """A number spelled in European, Anglo-Saxon or damaged form; null if it is none."""

    def read(t: str) -> str:
        plain = (
            f"CASE WHEN {fits(t, r'^[0-9]+,[0-9]{3}$')} THEN replace({t}, ',', '')"
            f" WHEN {fits(t, r'^[0-9]{1,3}(\.[0-9]{3})*(,[0-9]+)?$')} THEN translate({t}, ',.', '.')"
            f" WHEN {fits(t, r'^[0-9]{1,3},[0-9]{3},[0-9]{1,2}$')} THEN regexp_replace({t}, '^([0-9]+),([0-9]+),', '$1$2.')"
            f" WHEN {fits(t, r'^[0-9]{1,3}\.[0-9]{3}\.[0-9]{1,2}$')} THEN regexp_replace({t}, '^([0-9]+)[.]', '$1')"
            f" WHEN {fits(t, r'^[0-9]{4,},[0-9]{1,2}$')} THEN replace({t}, ',', '.')"
            f" ELSE replace({t}, ',', '') END")
        return _number(plain)

    # The Cyrillic letter dze is read for the digit 5; blanks inside numbers go away.
    return let(f"translate({strip(text)}, 'Ѕѕ \\u00a0', '55')", read)


def coerce_decimal(text: str) -> str:
    """Number of a hand-typed record field; anything unreadable counts as zero."""

    def read(t: str) -> str:
        plain = (
            f"CASE WHEN {fits(t, r'^[0-9]+,[0-9]{3}$')} THEN replace({t}, ',', '')"
            f" WHEN {fits(t, r'^[0-9]{1,3}(\.[0-9]{3})*(,[0-9]+)?$')} THEN translate({t}, ',.', '.')"
            f" ELSE replace({t}, ',', '') END")
        return f"coalesce(try_cast(nullif({plain}, '') AS {PARSED}), CAST(0 AS {PARSED}))"

    return let(f"replace(trim({text}), ' ', '')", read)


def parse_valid(text: str, cap: int) -> str:
    """The amount when positive and credible, else null."""
    return let(parse_amount(text), lambda a: when(f"{a} > 0 AND {a} <= {cap}", a))


# --- Dates ---------------------------------------------------------------------------------------------

# Accepted spellings by shape, tried top down.
#   shape, Spark pattern, two-digit year, month-first
DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy", False, False),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", False, False),
    (r"^\d{1,2}\.\d{1,2}\.\d{2}$", "d.M.yy", True, False),
    (r"^\d{1,2}/\d{1,2}/\d{2}$", "d/M/yy", True, False),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d", False, False),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy", False, False),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy", False, True),
    (r"^\p{L}{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy", False, False),
    (r"^\d{1,2} \p{L}{3,} \d{4}$", "d MMMM yyyy", False, False),
    (r"^\d{1,2} \p{L}{3} \d{4}$", "d MMM yyyy", False, False),
    (r"^\p{L}{3} \d{1,2}, \d{4}$", "MMM d, yyyy", False, False),
    (r"^\d{8}$", "yyyyMMdd", False, False),
    (r"^\d{1,2}\.\p{L}{3}\.\d{4}$", "d.MMM.yyyy", False, False),
    (r"^\d{1,2}\.\p{L}{3}\.\d{2}$", "d.MMM.yy", True, False),
]


def clean_date(raw: str) -> str:
    """Trimmed, with a comma between digits read as a dot."""
    return f"regexp_replace(trim({raw}), '([0-9]),([0-9])', '$1.$2')"


def parse_date(text: str) -> str:
    """struct(day date, month_first boolean) of a cleaned text, null if no spelling fits. The shape test
    keeps failing parses, and their exceptions, off the common path."""

    def attempt(shape: str, pattern: str, short_year: bool, month_first: bool) -> str:
        def hit(d: str) -> str:
            # Two-digit years 69..99 belong to the last century.
            day = f"CAST(CASE WHEN year({d}) >= 2069 THEN add_months({d}, -1200) ELSE {d} END AS date)" if short_year else d
            return when(f"{d} IS NOT NULL", f"named_struct('day', {day}, 'month_first', {str(month_first).lower()})")

        return when(fits(text, shape), let(f"try_to_date({text}, '{pattern}')", hit))

    return coalesce(*[attempt(*shape) for shape in DATE_SHAPES])


# --- Tax numbers ---------------------------------------------------------------------------------------


def normalize_vat(number: str) -> str:
    """Digits of a tax number, without blanks and country prefix."""
    return f"regexp_replace(upper(replace({number}, ' ', '')), '^(МК|MK)', '')"
