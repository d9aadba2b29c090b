"""Token estimates and keyword extraction as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions.text import NO_SPACE, SPACE, char_class, inside

_WORD_START = f"(?<![^{SPACE}])"
_WORD_END = f"(?![^{SPACE}])"
_CJK = f"[{S.CJK_BASIC}]"

SEARCH_SPLIT = f"[{SPACE}{char_class(S.SEARCH_MARKS)}]+"
#: What lies between two splits, of two characters at least; for Arrow tasks.
SEARCH_WORD = f"[^{SPACE}{char_class(S.SEARCH_MARKS)}]{{2,}}"
WORD_PATTERN = "[\\p{L}\\p{N}_]+"


def estimate_tokens(col: Column) -> Column:
    """Ideographs / 1.5 + words * 1.3 + marks * 0.5, truncated.

    A match from a word's first letter to its end counts the words with a letter, reading the text
    once. Words whose letters are all ideographs are taken off, where there are any.
    """
    # Plain letters first: the class of all white space is slow to test, at each character or position.
    with_letter = F.regexp_count(col, F.lit(f"\\p{{L}}[A-Za-z]*+{NO_SPACE}*+"))
    ideographs_only = F.when(
        col.rlike(_CJK),
        F.regexp_count(col, F.lit(f"(?![A-Za-z ]){_WORD_START}(?=[^{SPACE}{S.CJK_BASIC}]*+{_CJK})[^{SPACE}A-Za-z]++{_WORD_END}")),
    ).otherwise(0)
    marks = F.length(col) - F.length(F.regexp_replace(col, f"{inside(S.ESTIMATE_MARKS)}+", ""))
    return (
        F.regexp_count(col, F.lit(_CJK)) / 1.5 + (with_letter - ideographs_only) * F.lit(1.3) + marks * F.lit(0.5)
    ).cast("bigint")


def estimate_tokens_budget(col: Column) -> Column:
    """Ideographs plus a quarter of the other characters, plus ten percent."""
    cjk = F.regexp_count(col, F.lit(_CJK))
    return F.floor((cjk + (F.length(col) - cjk) / 4) * F.lit(1.1)).cast("bigint")


def search_tokens(col: Column, stop: Sequence[str] = S.SEARCH_STOP_WORDS) -> Column:
    """Retrieval tokens: case kept, stop words and single characters dropped."""
    words = F.split(col, SEARCH_SPLIT)
    return F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def keywords(col: Column, stop: Sequence[str] = S.SEARCH_STOP_WORDS, limit: int = 10) -> Column:
    """First ``limit`` distinct retrieval tokens, in text order."""
    return F.slice(F.array_distinct(search_tokens(col, stop)), 1, limit)


def core_keywords(col: Column, stop: Sequence[str] = S.SEARCH_STOP_WORDS) -> Column:
    return F.slice(keywords(col, stop), 1, 5)


def word_keywords(
    col: Column, stop: Sequence[str] = S.GATE_STOP_WORDS, lower: bool = True, limit: int | None = None
) -> Column:
    """Runs of word characters longer than one, without stop words."""
    text = F.lower(col) if lower else col
    words = F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0)
    kept = F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*stop))
    return F.slice(kept, 1, limit) if limit else kept


def check_keywords(col: Column, stop: Sequence[str] = S.CHECK_STOP_WORDS) -> Column:
    """Answer-checker keywords: marks removed (not spaced), then split on whitespace."""
    bare = F.regexp_replace(col, f"[^\\p{{L}}\\p{{N}}_{SPACE}]", "")
    return F.filter(F.split(bare, f"[{SPACE}]+"), lambda w: (F.length(w) > 1) & ~w.isin(*stop))


def display_keywords(col: Column, stop: Sequence[str] = S.DISPLAY_STOP_WORDS, limit: int = 5) -> Column:
    bare = F.translate(F.replace(F.replace(col, F.lit("["), F.lit("")), F.lit("]"), F.lit("")), S.DISPLAY_MARKS, "")
    words = F.filter(F.split(bare, " "), lambda w: (F.length(w) > 1) & w.rlike(f"[^{SPACE}]") & ~w.isin(*stop))
    return F.slice(words, 1, limit)


def stored_keywords(col: Column) -> Column:
    """Stored keywords as a clean array; ``col`` is text holding null, a word, or a JSON list."""
    as_list = F.from_json(col, "array<string>")
    is_list = col.rlike("^\\s*\\[")
    words = F.when(is_list, as_list).otherwise(F.array(col))
    trimmed = F.transform(F.coalesce(words, F.array().cast("array<string>")), lambda w: F.trim(w))
    return F.filter(trimmed, lambda w: w.isNotNull() & (w != ""))


def occurring_keywords(words: Column, content: Column) -> Column:
    return F.filter(words, lambda w: F.contains(content, w))


def lower_words(col: Column) -> Column:
    """Lower-cased whitespace words, empties dropped."""
    return F.filter(F.split(F.lower(col), f"[{SPACE}]+"), lambda w: w != "")


def overlap_share(left: Column, right: Column) -> Column:
    """Share of the distinct ``left`` words that occur in ``right``; 0 when ``left`` is empty."""
    base = F.size(F.array_distinct(left))
    return F.when(base > 0, F.size(F.array_intersect(left, right)) / base).otherwise(0.0)


def jaccard(left: Column, right: Column) -> Column:
    joined = F.size(F.array_union(left, right))
    both = (F.size(left) > 0) & (F.size(right) > 0)
    return F.when(both, F.size(F.array_intersect(left, right)) / joined).otherwise(0.0)
