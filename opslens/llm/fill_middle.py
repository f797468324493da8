"""Fill-in-the-middle examples: a text is cut in three, and its middle is asked for last.

A text is a list of units: blanks with the word behind them, and the blanks at the end.  Two hashes of the identifier
choose the units where the prefix and the middle end, a third whether the text is rearranged, a fourth in which order.

Cuts are found in the bytes of a text, but lengths are counted in characters.  ``Exceptions`` translates between both: it
lists only the characters of more than one byte, by where they start and how many bytes too many stand before them, so
everything between two of them is plain arithmetic and a search in the list finds the rest.

``restore`` takes the output of an example and its form and gives the exact text.  Marks cannot be confused with the text:
texts that hold one stay plain, and no mark can begin inside another or at the end of a part.

Null texts count as empty and stay plain; empty and very long texts are cut like any other, in one piece.  A null identifier
is hashed as the word ``null``.  Repeated rows give equal examples, other columns are carried along, and an empty table
stays empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import table

# Fixed values of the format.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, SPM, PSM = "plain", "spm", "psm"
SEED = 42
#: Of a hundred texts, those that are rearranged, and of these those that begin with the suffix.
REARRANGED, SUFFIX_FIRST = 50, 80

BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes too many of the character that a byte starts; 255 for bytes inside a character.
EXCESS = np.zeros(256, np.uint8)
EXCESS[0x80:0xC0], EXCESS[0xC0:0xE0], EXCESS[0xE0:0xF0], EXCESS[0xF0:] = 255, 1, 2, 3


class Exceptions:
    """The characters of a text that have more than one byte.

    ``at_byte`` and ``at_char`` are their places, ``excess`` the bytes too many up to and with each of them.
    """

    def __init__(self, raw: np.ndarray):
        extra = EXCESS[raw]
        self.at_byte = np.flatnonzero((extra > 0) & (extra < 255))
        self.excess = np.concatenate([[0], np.cumsum(extra[self.at_byte].astype(np.int64))])
        self.at_char = self.at_byte - self.excess[:-1]

    def chars(self, cut: np.ndarray | int) -> np.ndarray:
        """Characters before a byte place that lies between characters."""
        return cut - self.excess[np.searchsorted(self.at_byte, cut)]

    def bytes(self, cut: np.ndarray | int) -> np.ndarray:
        """The byte place before which so many characters stand."""
        return cut + self.excess[np.searchsorted(self.at_char, cut)]


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Byte places where the units end: after every word, and after blanks at the end of the text."""
    blank = BLANK[raw]
    ends = np.flatnonzero(~blank & np.append(blank[1:], True)) + 1
    return np.append(ends, len(raw)) if len(raw) and blank[-1] else ends


def choices(doc_id: object) -> list[int]:
    """Four numbers that only depend on the identifier."""
    code = hashlib.sha256(f"{SEED}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(code[i:i + 8], 16) for i in range(0, 32, 8)]


def example(doc_id: object, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, characters of prefix and middle, output) of one text."""
    raw = np.frombuffer(text, np.uint8)
    ends = np.concatenate([[0], unit_ends(raw)])
    n = len(ends) - 1
    h1, h2, h3, h4 = choices(doc_id)
    if not text or h3 % 100 >= REARRANGED or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    index = Exceptions(raw)
    first, second = (int(index.chars(ends[k])) for k in sorted((h1 % (n + 1), h2 % (n + 1))))
    low, high = int(index.bytes(first)), int(index.bytes(second))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < SUFFIX_FIRST:
        return n, SPM, first, second - first, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))
    return n, PSM, first, second - first, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))


def restore(output: bytes, form: str) -> bytes:
    """The text of an example."""
    if form == PLAIN:
        return output
    head, middle = output.split(MIDDLE, 1)
    if form == PSM:
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX, 1)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX, 1)
    return prefix + middle + suffix


FIELDS = "n long, form string, prefix_chars long, middle_chars long, output binary, restored_sha256 string"


def _made(doc_id: Column, text: Column) -> Column:
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
    names = ["n", "form", "prefix_chars", "middle_chars", "output", "restored_sha256"]

    @F.arrow_udf(f"struct<{FIELDS.replace(' ', ': ').replace(',:', ',')}>")
    def make(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for ids, texts in batches:
            rows = []
            for doc, value in zip(ids.to_pylist(), texts):
                made = example(doc, value.as_py())
                rows.append((*made, hashlib.sha256(restore(made[4], made[1])).hexdigest()))
            columns = zip(*rows) if rows else [()] * len(types)
            yield pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return make(doc_id, F.coalesce(text, F.lit("")).cast("binary"))


def examples(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of ``df`` as one struct ``row``, with ``n, form, prefix_chars, middle_chars, output, restored_sha256``."""
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _made(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")).alias("made"))
    return rows.select("row", "made.n", "made.form", "made.prefix_chars", "made.middle_chars", F.col("made.output").cast("string").alias("output"), "made.restored_sha256")


def op11_fill_middle(spark, sf_dir: str) -> DataFrame:
    """Form, cuts and digests of the example of every document."""
    made = examples(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("row.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), "restored_sha256")


SQL_TEXT = r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, 'null')) AS code FROM documents),
cut AS (SELECT doc_id, text, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
  [('0x' || substr(code, 8 * k + 1, 8))::BIGINT FOR k IN range(4)] AS h FROM docs),
chosen AS (SELECT *, len(units)::BIGINT AS n, h[1] % (len(units) + 1) AS a, h[2] % (len(units) + 1) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain'
    WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT doc_id, text, n, form, coalesce(array_to_string(units[1:least(a, b)], ''), '') AS prefix,
  coalesce(array_to_string(units[least(a, b) + 1:greatest(a, b)], ''), '') AS middle, coalesce(array_to_string(units[greatest(a, b) + 1:], ''), '') AS suffix FROM chosen)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM parts
"""

QUERIES = {"op11_fill_middle": op11_fill_middle}
SQL = {"op11_fill_middle": SQL_TEXT}
