"""Fill-in-the-middle: texts cut into prefix, middle and suffix, which are put in the order that a model is trained on.

One fullmatch of `(unit)*` from the `regex` library keeps every repetition of the group, so `match.ends(1)` is the list
of all places where a text can be cut: its length is the number of units, and two look-ups give both cuts. Only of texts
of more than `WINDOW` characters is a match kept to `WINDOW` units, which bounds what is held; the next one goes on where
it ended."""

from __future__ import annotations

from array import array
from collections.abc import Sequence

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: One code point, line feeds included.
CODE_POINT = r"(?s:.)"
#: Units that one match may cover of a longer text.
WINDOW = 1 << 20

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"


def draws(doc_id: Column, seed: int = 1) -> list[Column]:
    """Four numbers below 2**32 for each document, from the hash of seed and id. A null id counts as empty text."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint") for k in range(4)]


def ends_of(text: str, whole: regex.Pattern, part: regex.Pattern) -> Sequence[int]:
    """Where the units of a text end: all captures of one fullmatch, or of one match after the other of a long text."""
    if len(text) <= WINDOW:
        match = whole.fullmatch(text)
        if match is None:
            raise ValueError("the unit does not match the text from one end to the other")
        return match.ends(1)
    out = array("q")
    while not out or out[-1] < len(text):
        ends = part.match(text, out[-1] if out else 0).ends(1)
        if not ends or ends[-1] == (out[-1] if out else 0):
            raise ValueError("the unit does not match the text from one end to the other")
        out.extend(ends)
    return out


def fill_in_middle(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1, plain_from: int = 90, spm_below: int = 20,
                   unit: str = CODE_POINT) -> DataFrame:
    """doc_id, n (units), form (plain, psm, spm), prefix_units, middle_units (null if plain), output: each row of
    `docs` transformed. Of the four draws, the first two modulo n + 1 are the cuts, the third says whether the text stays
    plain (modulo 100, from `plain_from`), the fourth whether its form is spm (modulo 100, below `spm_below`).

    A null text is empty. Empty texts and texts that hold a mark stay plain. Rows that repeat get the same result each. A
    null doc_id draws as empty text. Bytes that are not UTF-8 count as a unit each and are given out as they are, in a
    binary output. `unit` must match every text from end to end (all code points do); a text that it cannot be cut into
    raises ValueError. Very long texts take one match per `WINDOW` units. Other columns are not read."""
    whole, part = regex.compile(f"({unit})*"), regex.compile(f"({unit}){{0,{WINDOW}}}+")
    marks = regex.compile(MARKS)
    drawn = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("t"),
        *[h.alias(f"h{k}") for k, h in enumerate(draws(F.col(doc_id), seed), 1)])

    def row(raw: bytes, h1: int, h2: int, h3: int, h4: int) -> tuple:
        value = raw.decode("utf-8", "surrogateescape")
        ends = ends_of(value, whole, part)
        n = len(ends)
        if not value or h3 % 100 >= plain_from or marks.search(value):
            return n, "plain", None, None, raw
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        one, two = (ends[x - 1] if x else 0 for x in (low, high))
        prefix, middle, suffix = value[:one], value[one:two], value[two:]
        form = "spm" if h4 % 100 < spm_below else "psm"
        out = f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}" if form == "spm" else f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
        return n, form, low, high - low, out.encode("utf-8", "surrogateescape")

    def run(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                given = batch.slice(low, 256)
                made = [row(*x) for x in zip(*(given.column(k).to_pylist() for k in range(1, 6)))]
                n, form, first, second, out = (list(x) for x in zip(*made))
                yield pa.RecordBatch.from_pydict({
                    "doc_id": given.column(0), "n": pa.array(n, pa.int64()), "form": pa.array(form, pa.string()),
                    "prefix_units": pa.array(first, pa.int64()), "middle_units": pa.array(second, pa.int64()), "output": pa.array(out, pa.binary())})

    kind = drawn.schema["doc_id"].dataType.simpleString()
    return drawn.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_units bigint, middle_units bigint, output binary")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of, as bytes. No text with a mark of its own has been cut, so the marks found
    are those that were put in, and parts of `output` stay bytes: marks are looked for in Latin-1, a character a byte."""
    parts = F.split(F.decode(output, "ISO-8859-1"), MARKS, -1)
    psm = F.concat(parts[1], parts[3], parts[2])
    spm = F.concat(parts[2], parts[3], parts[1])
    return F.when(form == "plain", output).when(form == "psm", F.encode(psm, "ISO-8859-1")).otherwise(F.encode(spm, "ISO-8859-1"))
