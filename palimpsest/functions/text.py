"""Text functions on columns: bytes, code points, graphemes, tokens, shapes. Byte offsets are half-open UTF-8 offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.spans import let, running

#: Words that are no keywords.
STOP_WORDS = "a an and are as at be but by for from has have i in is it its my of on or our the this to was were will with you your".split()
#: A token is letters, digits and underscores, with single apostrophes or hyphens inside.
TOKEN = r"[\p{L}\p{N}_]+(?:['-][\p{L}\p{N}_]+)*"
#: A word of the span model's splitter: word characters with - or _ between them, or one other character.
MODEL_WORD = r"[\p{L}\p{N}_]+(?:[-_][\p{L}\p{N}_]+)*|\S"
#: A boundary of an ASCII word, for patterns that are matched on bytes; Java's \b takes other letters for parts of words too.
ASCII_BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"
LANGUAGES = ("en", "es", "fr", "de", "pt", "it", "unknown")


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    return bytes_slice(utf8(text), start, end)


def bytes_slice(data: Column, start: Column, end: Column) -> Column:
    """The same of a text's bytes, for many slices of one text: encoding copies the whole text."""
    return F.substr(data, start + 1, end - start).cast("string")


def chars_before(data: Column, at: Column, size: int) -> Column:
    """The last size characters of a text, given as its bytes, before a byte offset."""
    near = F.make_valid_utf8(bytes_slice(data, F.greatest(F.lit(0), at - 4 * (size + 1)), at))
    return F.substr(near, F.greatest(F.length(near) - size + 1, F.lit(1)), F.lit(size))


def chars_after(data: Column, at: Column, size: int) -> Column:
    """The first size characters from a byte offset on."""
    return F.substr(F.make_valid_utf8(bytes_slice(data, at, F.least(F.octet_length(data), at + 4 * (size + 1)))), F.lit(1), F.lit(size))


def byte_to_char(text: Column, at: Column) -> Column:
    """The code point offset of a byte offset; null outside of the text or inside a character."""
    prefix = F.substr(utf8(text), F.lit(1), at).cast("string")
    return F.when((at >= 0) & (at <= F.octet_length(text)) & F.is_valid_utf8(prefix), F.length(prefix))


def char_to_byte(text: Column, at: Column) -> Column:
    return F.when((at >= 0) & (at <= F.length(text)), F.octet_length(F.substr(text, F.lit(1), at)))


def graphemes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))


def grapheme_to_byte(text: Column, at: Column) -> Column:
    """The byte offset of a grapheme offset (that of the end beyond it). Only the text before it is looked at."""
    pattern = F.concat(F.lit(r"\A\X{0,"), F.greatest(at, F.lit(0)).cast("string"), F.lit("}+"))
    return F.octet_length(F.call_function("regexp_extract", text, pattern, F.lit(0)))


def matches(text: Column, regex: str) -> Column:
    """array<struct<s:int, e:int, v:string>>: byte range and value of every match, in order. The pattern must not match the empty string.

    The matches and the gaps between them make up the text in turn, so offsets are running sums of their byte lengths.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(regex), F.lit(0)), F.split(text, regex, -1)
    empty = F.array().cast("array<struct<s:int,e:int,v:string>>")

    def ranges(m):
        lengths = F.zip_with(F.slice(gaps, F.lit(1), F.size(m)), m, lambda g, x: F.struct(F.octet_length(g).alias("gap"), F.octet_length(x).alias("own"), x.alias("v")))

        def placed(pairs):
            at = running(F.transform(pairs, lambda p: p["gap"] + p["own"]), F.lit(0), lambda a, x: a + x)
            return F.zip_with(pairs, at, lambda p, a: F.struct((a + p["gap"]).alias("s"), (a + p["gap"] + p["own"]).alias("e"), p["v"].alias("v")))

        return let(lengths, placed)

    return F.when(text.rlike(regex), let(found, ranges)).otherwise(empty)


def normalize_token(token: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(token)), r"^_+|_+\z", "")


def tokens(text: Column) -> Column:
    """array<struct<byte_start, byte_end, token, norm>>."""
    return F.transform(matches(text, TOKEN), lambda m: F.struct(m["s"].alias("byte_start"), m["e"].alias("byte_end"), m["v"].alias("token"), normalize_token(m["v"]).alias("norm")))


def token_norms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), normalize_token)


def keywords(norms: Column) -> Column:
    """Distinct normalised tokens that are no stop words, in first-seen order."""
    return F.array_distinct(F.filter(norms, lambda t: (t != "") & ~t.isin(STOP_WORDS)))


def model_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(MODEL_WORD), F.lit(0))


def token_shape(value: Column) -> Column:
    """Letters as A, digits as 9, white space as a blank, 32 characters at most."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\p{L}", "A"), r"\p{N}", "9"), r"(?U)\s", " ")
    return F.array_join(F.slice(graphemes(shape), F.lit(1), F.lit(32)), "")


def length_bucket(n: Column) -> Column:
    return F.when(n <= 4, "1-4").when(n <= 8, "5-8").when(n <= 16, "9-16").when(n <= 32, "17-32").otherwise("33+")


def score_bucket(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score < 0.5, "0.00-0.49").when(score < 0.7, "0.50-0.69").when(score < 0.85, "0.70-0.84").otherwise("0.85-1.00")


def placeholder(label: Column) -> Column:
    """<LABEL>: upper case, runs of other characters as one underscore."""
    return F.concat(F.lit("<"), F.regexp_replace(F.regexp_replace(F.upper(label), "[^A-Z0-9]+", "_"), r"^_+|_+\z", ""), F.lit(">"))


def language(value: Column) -> Column:
    """The known language code, lower-cased; null for any other."""
    low = F.lower(F.trim(value))
    return F.when(low.isin(*LANGUAGES), low)
