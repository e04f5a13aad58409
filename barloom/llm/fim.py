"""Fill-in-middle transformation by repeated-capture matching.

One fullmatch of (unit)* over a whole text retains the end of every repetition of its
group; their number is n, and both cuts are looked up among them, so nothing steps
through the text. The regex library keeps two words for each capture: a task holds
one text's captures at a time, some 60 bytes a unit.

A text is left plain if it is empty, holds a marker (it could not be told from one of
the format's own), or by its share; else prefix, suffix and middle are put in the order
of psm or spm. `restored` rebuilds the text from output and form with expressions.

Defined cases: a null text is an empty one; a null id hashes as no digits; equal rows
give equal results, as all choices follow from the id; other columns are ignored, a
kept one named like a result gives way to it; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from barloom.llm._run import kept, packed, small_batches, table, unpacked

#: A run of letters, or one other character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percent of the texts that are left plain, and of the others that put the suffix first.
PLAIN, SUFFIX_FIRST = 10, 20
SALT = "1:"


@lru_cache
def _units(unit: str):
    import regex

    return regex.compile(f"({unit})*")


def cuts(text: str, h1: int, h2: int, unit: str = UNIT) -> tuple[int, int, int]:
    """(number of units, end of the prefix, end of the middle), in code points."""
    match = _units(unit).fullmatch(text)
    if match is None:
        raise ValueError("the unit doesn't cover every text")
    ends = match.ends(1)
    low, high = sorted((h1 % (len(ends) + 1), h2 % (len(ends) + 1)))
    return len(ends), ends[low - 1] if low else 0, ends[high - 1] if high else 0


def transformed(text: str, key: str, unit: str = UNIT) -> tuple[int, str, str, int | None, int | None]:
    """(units, form, output, characters of prefix and of middle) of one text; key is its id in digits."""
    digest = hashlib.sha256((SALT + key).encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    n, low, high = cuts(text, h1, h2, unit)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN:
        return n, "plain", text, None, None
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, "spm", SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle, low, high - low
    return n, "psm", PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle, low, high - low


def fill_in_middle(docs: DataFrame, *keep: str, key: str = "doc_id", unit: str = UNIT) -> DataFrame:
    """The kept columns of docs (with text and key) and n, form, output, prefix_chars, middle_chars."""
    small_batches(docs.sparkSession)
    own = StructType.fromDDL("n long, form string, output string, prefix_chars long, middle_chars long")
    keep = kept(keep, *own.names)
    rows = packed(docs, keep, text=F.col("text"), key=F.col(key).cast("string"))
    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())

    def run(batches):
        for b in batches:
            got = [transformed(t.as_py() or "", k.as_py() or "", unit) for t, k in zip(b.column("text"), b.column("key"), strict=True)]
            columns = zip(*got, strict=True) if got else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([b.column("row"), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], ["row", *own.names])

    return unpacked(rows.mapInArrow(run, StructType([rows.schema["row"], *own])), keep, *own.names)


def restored(output: Column, form: Column) -> Column:
    """The text again: no part holds a marker, so the first of each kind is the format's own."""

    def part(first: str, after: str) -> Column:
        start = F.locate(first, output) + len(first)
        end = F.locate(after, output) if after else F.char_length(output) + 1
        return F.substring(output, start, end - start)

    psm = F.concat(part(PREFIX, SUFFIX), part(MIDDLE, ""), part(SUFFIX, MIDDLE))
    spm = F.concat(part(PREFIX, MIDDLE), part(MIDDLE, ""), part(SUFFIX, PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = fill_in_middle(table(spark, sf_dir, "documents"), "doc_id")
    again = restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(again, 256).alias("restored_sha256"))


OP11_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS unit,
        sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS digest
    FROM documents
), h AS (
    SELECT *, len(unit) AS n, ('0x' || digest[1:8])::BIGINT AS h1, ('0x' || digest[9:16])::BIGINT AS h2, ('0x' || digest[17:24])::BIGINT AS h3, ('0x' || digest[25:32])::BIGINT AS h4
    FROM t
), c AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
    FROM h
), p AS (
    SELECT *, array_to_string(unit[1:low], '') AS prefix, array_to_string(unit[low + 1:high], '') AS middle, array_to_string(unit[high + 1:], '') AS suffix
    FROM c
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM p
"""
