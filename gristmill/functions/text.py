"""Text measures as column expressions; Python's notions of white space and line breaks, spelt out."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as white space and as a line break.
WS = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x85\u2028\u2029]"
#: The stop words, sentence ends and bullets of the quality rules.
STOP_WORDS = (
    "the be to of and a in that have it for not on with he as you do at this but his by from they we say her she or "
    "an will my one all would there their what so up out if about who get which go me when make can like time no just "
    "him know take people into year your good some could them see other than then now look only come its over think also "
    "back after use two how our work first well way even new want because any these give day most us"
).split()
TERMINAL = [".", "?", "!", '"', "'", "»", "…"]
BULLET = r"^\s*[•\-*+►▸▶◆◇○●]\s"


def let(value: Column, f) -> Column:
    """``f(value)`` with the value made once a row, however often ``f`` mentions it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def fixed(c: Column) -> Column:
    """``c`` as it is, but made where it stands: filters on it aren't pushed below it, and it isn't written out again in every expression that mentions it.

    The condition always holds; the optimizer takes it for one that may not.
    """
    return F.when(F.spark_partition_id() >= 0, c)


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(c: Column) -> Column:
    """Runs of visible characters."""
    return F.filter(F.split(text_of(c), f"{WS}+"), lambda w: w != "")


def lines(c: Column) -> Column:
    """Lines without the empty one after a last break; none for an empty text."""
    parts = F.split(text_of(c), BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def solid_lines(c: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(lines(c), strip), lambda x: x != "")


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def count_if(array: Column, f) -> Column:
    return F.size(F.filter(array, f))


def n_words(c: Column) -> Column:
    return F.size(words(c))


def n_lines(c: Column) -> Column:
    return F.size(lines(c))


def alpha_ratio(c: Column) -> Column:
    t = text_of(c)
    return ratio(F.length(t) - F.length(F.regexp_replace(t, r"\p{L}+", "")), F.length(t))


def latin_ratio(c: Column) -> Column:
    t = text_of(c)
    return ratio(F.regexp_count(t, F.lit("[A-Za-z]")), F.length(t))


def special_ratio(c: Column) -> Column:
    """Characters that are neither letters, digits nor white space."""
    t = text_of(c)
    return ratio(F.regexp_count(t, F.lit(r"[^\p{L}\p{N}" + WS[1:-1] + "]")), F.length(t))


_INNER = WS[1:-1]


def token_count(c: Column, pattern: str) -> Column:
    """Runs of visible characters of which ``pattern`` matches a beginning; one scan, no array of words."""
    return F.regexp_count(text_of(c), F.lit(f"(?<![^{_INNER}])(?:{pattern})"))


def stop_word_count(c: Column) -> Column:
    """Occurrences of stop words, with multiplicity, punctuation around words taken off."""
    marks = """[.,!?;:'"]*"""
    return token_count(c, f"(?i){marks}(?:{'|'.join(STOP_WORDS)}){marks}(?![^{_INNER}])")


def avg_sentence_length(c: Column) -> Column:
    """Words of a sentence on average; a sentence ends at a run of ``.!?``.

    The words of all sentences together are those of the text with the ends as blanks.
    """
    t = F.regexp_replace(text_of(c), "[.!?]+", "\x02")
    total = F.size(words(F.translate(t, "\x02", " ")))
    return ratio(total, F.regexp_count(t, F.lit(f"(?:^|\x02)[^\x02]*?[^\x02{WS[1:-1]}]")))


def truncated(c: Column, limit: int) -> Column:
    """The first ``limit`` words with single blanks between; a shorter text as it is."""
    w = words(c)
    return F.when(F.size(w) > limit, F.array_join(F.slice(w, 1, limit), " ")).otherwise(c)


def preview(c: Column) -> Column:
    return F.translate(F.left(text_of(c), F.lit(500)), "\n", " ")


def match_key(c: Column, n: int = 200) -> Column:
    return F.left(strip(text_of(c)), F.lit(n))


def lm_normal(c: Column) -> Column:
    """Digits as 0 and white space as single blanks, for language models."""
    return strip(F.regexp_replace(F.regexp_replace(text_of(c), r"[0-9]", "0"), f"{WS}+", " "))


def fingerprint_text(c: Column) -> Column:
    """Lower case with single blanks, what copies are told by."""
    return F.array_join(words(F.lower(c)), " ")


def duplicate_share(array: Column) -> Column:
    """Share of entries that repeat an earlier one."""
    return ratio(F.size(array) - F.size(F.array_distinct(array)), F.size(array))


def duplicate_line_fraction(c: Column) -> Column:
    return duplicate_share(solid_lines(c))


def duplicate_paragraph_fraction(c: Column) -> Column:
    return duplicate_share(F.filter(F.transform(F.split(text_of(c), "\n\n"), strip), lambda x: x != ""))
