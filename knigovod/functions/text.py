"""Text normalization and small text forms."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from knigovod.fixed_values import DESCRIPTION_KEYWORDS, LATIN_OF_CYRILLIC, LEGAL_FORM_PATTERN, LOOKALIKES
from knigovod.functions import sql
from knigovod.functions.amounts import let
from knigovod.functions.sql import rx


def lookalike_regex(keyword: str) -> str:
    """Pattern of a known keyword that scanner look-alikes also match."""
    parts = []
    for i, c in enumerate(keyword):
        if c == " ":
            parts.append(r"\s*" if keyword[i + 1:i + 2] in tuple(":;-.,)") + ("",) else r"\s+")
        elif c in LOOKALIKES:
            parts.append("[" + c + LOOKALIKES[c] + "]")
        else:
            parts.append(c if c.isalnum() or c == "_" else "\\" + c)
    return "".join(parts)


def literal_runs(keyword: str) -> list[str]:
    """Runs of letters, in lower case, that every hit of the keyword's `lookalike_regex` holds."""
    bare = "".join(" " if c in LOOKALIKES or not c.isalpha() else c.lower() for c in keyword)
    return sorted(set(bare.split()))


_CLASSES = "map(" + ", ".join(sql.quoted(x) for c, more in LOOKALIKES.items() for x in (c, f"[{c}{more}]")) + ")"


def lookalike_pattern(keyword: str) -> str:
    """`lookalike_regex` of a keyword that is only known in the data, as SQL text."""

    def of_letters(letters: str) -> str:
        c, i = sql.fresh("c"), sql.fresh("i")
        after = f"coalesce(get({letters}, {i} + 1), '')"
        blank = f"CASE WHEN {after} IN ('', ':', ';', '-', '.', ',', ')') THEN {sql.quoted(r'\s*')} ELSE {sql.quoted(r'\s+')} END"
        return (
            f"array_join(transform({letters}, ({c}, {i}) -> CASE WHEN {c} = ' ' THEN {blank}"
            f" ELSE coalesce(try_element_at({_CLASSES}, {c}), {sql.escape_regex(c)}) END), '')")

    return sql.let(f"split({keyword}, '')", of_letters)


def any_keyword(text: Column, keywords) -> Column:
    """Whether lower-case `text` holds one of the keywords."""
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))


#: Characters that composing may change or join to the one before: marks, jamo, those with another canonical form, and those
#: that the JVM's tables do not know yet.
COMPOSABLE = (
    r"[\p{M}\p{Cn}\x{37E}\x{374}\x{387}\x{900}-\x{FFF}\x{1100}-\x{11FF}\x{1F00}-\x{1FFF}\x{2000}\x{2001}\x{2126}\x{212A}\x{212B}\x{2329}\x{232A}\x{2ADC}"
    r"\x{F900}-\x{FAFF}\x{FB1D}-\x{FB4F}\x{1D15E}-\x{1D1C0}\x{2F800}-\x{2FA1D}]")


def compose_unicode(df: DataFrame, *columns: str) -> DataFrame:
    """Compose decomposed letters once, at ingest (Spark has no built-in for it). Only texts that hold such letters leave
    the JVM."""
    return df.withColumns({c: F.coalesce(_compose(F.when(F.col(c).rlike(COMPOSABLE), F.col(c))), F.col(c)) for c in columns})


def transliterate(text: Column) -> Column:
    """Macedonian Cyrillic to Latin: single letters in one pass, digraphs one by one."""
    single = [(c, l) for c, l in LATIN_OF_CYRILLIC if len(l) == 1]
    out = F.translate(text, "".join(c for c, _ in single), "".join(l for _, l in single))
    for cyrillic, latin in LATIN_OF_CYRILLIC:
        if len(latin) > 1:
            out = F.replace(out, F.lit(cyrillic), F.lit(latin))
    return out


def match_form(text: Column) -> Column:
    """Latin, without legal form and place, single-spaced."""
    bare = F.regexp_replace(transliterate(text), rx(LEGAL_FORM_PATTERN), " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def focus_text(text: Column) -> Column:
    """Header plus the first description lines: the part that tells what was bought."""
    lines = F.filter(
        F.split(text, r"\r\n|\r|\n"), lambda l: any_keyword(F.lower(l), DESCRIPTION_KEYWORDS))
    extra = F.array_join(F.transform(F.slice(lines, 1, 4), lambda line: F.trim(line)), " ")
    return F.substring(F.trim(F.concat(F.substring(text, 1, 350), F.lit(" "), extra)), 1, 500)


def file_name_part(text: Column, kept: str, length: int | None = None) -> Column:
    """Letters, digits and `kept` characters; everything else becomes an underscore."""
    out = F.regexp_replace(text, f"[^{kept}]", "_")
    return out if length is None else F.substring(out, 1, length)


def parse_flag(flag: Column) -> Column:
    """struct(severity, label, text) of a raw warning."""

    def read(colon: Column) -> Column:
        head = F.when(colon > 0, F.substr(flag, F.lit(1), colon - 1)).otherwise(flag)
        head = F.replace(
            F.lower(F.trim(F.regexp_replace(head, r"(?i)\[HIGH SEVERITY\]", ""))), F.lit("_"), F.lit(" "))
        label = F.concat(F.upper(F.substring(head, 1, 1)), F.substr(head, F.lit(2)))
        body = F.trim(F.when(colon > 0, F.substr(flag, colon + 1)).otherwise(flag))
        return F.struct(
            F.when(flag.rlike("(?i)HIGH SEVERITY"), "high").otherwise("warn").alias("severity"),
            F.when(label == "", "Validation").otherwise(label).alias("label"),
            F.when(body == "", flag).otherwise(body).alias("text"))

    return let(F.instr(flag, ":"), read)


def parse_flags(flags: Column) -> Column:
    return F.transform(flags, parse_flag)


def high_severity(flags: Column) -> Column:
    """Whether any raw warning blocks approval."""
    return F.exists(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.contains(f, F.lit("HIGH SEVERITY")))


def flag_summary(flags: Column) -> Column:
    """Badge text of a list of raw warnings, null when there are none."""
    n = F.size(flags)
    return (
        F.when(flags.isNull() | (n == 0), F.lit(None).cast("string"))
        .when(high_severity(flags), F.concat(n.cast("string"), F.lit(" · critical")))
        .when(n > 1, F.concat(n.cast("string"), F.lit(" warnings")))
        .otherwise(F.concat(n.cast("string"), F.lit(" warning")))
    )
