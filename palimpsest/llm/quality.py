"""Quality rules, line first: rules remove lines, then documents that lost too much text are rejected.

Words are runs of anything but the ASCII blanks (space, tab to carriage return); lines end at a line feed. A line with a word fails if
  * it does not end in closing punctuation (quotes and brackets may follow),
  * it shouts or is noise: a doubled exclamation mark, or more symbols ``[#*$%&|<>]`` than a tenth of its word characters,
  * it is navigation: three or more of ``| » ›`` or a bare menu word,
  * it holds a boilerplate phrase.
The document is kept if the base rules hold and its remaining lines have at least ``LEAST_SHARE`` hundredths of its word characters.

Base rules: ``n_words >= 10``, and at most a fifth of the words inside 5-word windows that occur again in the text.

Defined results: a null text has no words and fails; repeated rows get equal rows; one line of any length is one line; a null doc_id is a row like any other; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import bounded_batches, tidy

LEAST_WORDS = 10
MOST_REPEATED = 20
LEAST_SHARE = 60
WINDOW = 5
SYMBOLS = "#*$%&|<>"
#: Patterns in the syntax that both Python's re and RE2 read; matched against a line, the last two lower-cased.
ENDS = r"""[.!?:;…。！？]["'”’»)\]]*[ \t\r\x0b\x0c]*$"""
SHOUTS = r"!!"
MENU = r"^[ \t]*(home|menu|login|log in|sign in|sign up|register|search|next|previous|back to top|contact us|share|print)[ \t.!:]*$"
BOILERPLATE = r"(use of cookies|uses cookies|enable javascript|javascript is disabled|terms of use|terms of service|privacy policy|all rights reserved|lorem ipsum|click here to|subscribe to our newsletter)"
BARS = "|»›"

_words = re.compile("[^\x20\x09-\x0d]+").findall
_ends, _shouts, _menu, _boiler = (re.compile(p).search for p in (ENDS.replace("$", r"\Z"), SHOUTS, MENU.replace("$", r"\Z"), BOILERPLATE))


def line_fails(line: str, chars: int) -> bool:
    """chars: the line's word characters."""
    if not _ends(line) or _shouts(line):
        return True
    if 10 * sum(map(line.count, SYMBOLS)) > chars or sum(map(line.count, BARS)) >= 3:
        return True
    low = line.lower()
    return bool(_menu(low) or _boiler(low))


def repeated_words(words: list[str]) -> int:
    """Words inside 5-word windows that occur twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    two = np.unique(ids[:-1] * len(number) + ids[1:], return_inverse=True)[1]
    if int(two.max()) + 1 == n - 1:
        return 0
    four = np.unique(two[:-2] * n + two[2:], return_inverse=True)[1]
    _, five, counts = np.unique(four[:-1] * n + ids[4:], return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[five] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, again, 1)
    np.add.at(cover, again + WINDOW, -1)
    return int((np.cumsum(cover) > 0).sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, bool, bool, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, kept_chars (word characters of the lines that pass)."""
    text = text or ""
    words = _words(text)
    n, chars, kept_chars, copies, seen = len(words), sum(map(len, words)), 0, 0, set()
    for line in text.split("\n"):
        own = sum(map(len, _words(line)))
        if not own:
            continue
        if line in seen:
            copies += 1
        seen.add(line)
        if not line_fails(line, own):
            kept_chars += own
    repeated = repeated_words(words)
    failed = n < LEAST_WORDS or 100 * repeated > MOST_REPEATED * n
    return n, chars, sum(map(text.count, SYMBOLS)), copies, repeated, failed, not failed and 100 * kept_chars >= LEAST_SHARE * chars, kept_chars


def clean_text(text: str | None) -> str | None:
    """The lines that pass, with the wordless ones between them."""
    if text is None:
        return None
    return "\n".join(x for x in text.split("\n") if not (own := sum(map(len, _words(x)))) or not line_fails(x, own))


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, kept_chars long"


def evaluate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The columns of measure() for every document, and its cleaned text (null unless kept) if asked for."""
    bounded_batches(docs.sparkSession)
    names = [c.split()[0] for c in _OUT.split(", ")]

    def run(batches):
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.int64()]
        for b in batches:
            texts = b.column("text").to_pylist()
            found = [measure(t) for t in texts]
            columns = [b.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*found), kinds[1:])]] if found else [pa.array([], k) for k in kinds]
            extra = [pa.array([clean_text(t) if x[6] else None for t, x in zip(texts, found)], pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*names, *["clean_text"] * with_text])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(run), _OUT + ", clean_text string" * with_text)
