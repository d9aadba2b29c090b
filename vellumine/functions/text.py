"""Text-cleaning expressions: every function maps a Column to a Column."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellumine import settings as S


def char_class(chars: str) -> str:
    """Characters as the body of a regex class, readable by Java and RE2.

    Neighbouring code points become ranges, so a class test is a few comparisons.
    """
    quote = lambda c: "\\" + c if c in "\\]^[-&" else c
    points, out, i = sorted({ord(c) for c in chars}), [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        first, last = quote(chr(points[i])), quote(chr(points[j]))
        out.append(first if i == j else f"{first}-{last}" if j - i > 1 else first + last)
        i = j + 1
    return "".join(out)


def _told_fast(chars: str) -> str:
    """Characters as the body of a Java class. Java looks single ones below 256 up in one table, and tries ranges and others one
    by one; those are asked only for characters beyond the table."""
    low, high = "".join(f"\\u{ord(c):04x}" for c in sorted(set(chars)) if ord(c) < 256), "".join(c for c in chars if ord(c) >= 256)
    return low + (f"[\\x{{100}}-\\x{{{0xFFFF if max(high) <= chr(0xFFFF) else 0x10FFFF:x}}}&&[{char_class(high)}]]" if high else "")


def inside(chars: str) -> str:
    """Java class of these characters."""
    return f"[{_told_fast(chars)}]"


def outside(chars: str) -> str:
    """Java class of all characters but these; a range of frequent ones that holds none of these comes first."""
    plain = next((f"{a}-{z}" for a, z in ("!~", "az") if not any(a <= c <= z for c in chars)), "")
    return f"[{plain}[^{_told_fast(chars)}]]"


SPACE = char_class(S.ANY_SPACE)
#: The same for Java alone.
NO_SPACE, SPACES = outside(S.ANY_SPACE), inside(S.ANY_SPACE)
INLINE = char_class(S.INLINE_SPACE)
ANY_SPACE_CLASS = SPACE


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times, so that nested steps do not multiply the expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(col: Column) -> Column:
    """Trim all Unicode whitespace, not only spaces. A pattern would be tried at every space inside, and along a run of spaces
    from each of them."""
    return F.btrim(col, F.lit("".join(S.ANY_SPACE)))


def filled(col: Column) -> Column:
    """Whether anything but white space is there; reading stops at the first such character."""
    return col.rlike(NO_SPACE)


def letter_count(col: Column) -> Column:
    """Characters that are no white space."""
    return F.length(F.regexp_replace(col, f"{SPACES}+", ""))


def lines(col: Column) -> Column:
    return F.split(col, "\n")


def join_lines(col: Column) -> Column:
    return F.array_join(col, "\n")


def unescape_entities(col: Column) -> Column:
    """Decode named and numeric entities; those that yield ``&`` go last, so nothing is decoded twice."""
    table = F.create_map(*[F.lit(x) for pair in sorted(S.NAMED_ENTITIES.items()) for x in pair])

    def decode_named(text: Column) -> Column:
        names = F.array_distinct(F.regexp_extract_all(text, F.lit("&([A-Za-z]+[0-9]*);"), 1))
        known = F.filter(names, lambda n: (n != "amp") & F.map_contains_key(table, n))
        return F.aggregate(known, text, lambda acc, n: F.replace(acc, F.concat(F.lit("&"), n, F.lit(";")), table[n]))

    def decode_numeric(text: Column) -> Column:
        refs = F.array_distinct(F.regexp_extract_all(text, F.lit("&#([xX]?[0-9a-fA-F]+);"), 1))
        code = lambda n: F.when(
            F.lower(F.substring(n, 1, 1)) == "x", F.conv(F.substring(n, 2, 16), 16, 10)
        ).otherwise(n).try_cast("int")
        valid = F.filter(refs, lambda n: code(n).between(1, 0xFFFF) & (code(n) != 38))
        return F.aggregate(
            valid,
            text,
            lambda acc, n: F.replace(
                acc,
                F.concat(F.lit("&#"), n, F.lit(";")),
                # UTF-16BE code unit to character; chr() stops at 255.
                F.decode(F.unhex(F.lpad(F.hex(code(n)), 4, "0")), "UTF-16BE"),
            ),
        )

    decoded = decode_numeric(decode_named(col))
    for entity in ("&#38;", "&amp;"):
        decoded = F.replace(decoded, F.lit(entity), F.lit("&"))
    return F.when(col.contains("&"), decoded).otherwise(col)


def remove_html_tags(col: Column) -> Column:
    return unescape_entities(F.regexp_replace(col, S.TAG_PATTERN, ""))


def collapse_spaces(col: Column) -> Column:
    """Runs of spaces become one space, and so do runs of tabs."""
    return F.regexp_replace(F.regexp_replace(col, " +", " "), "\t+", " ")


def normalize_spaces(col: Column) -> Column:
    return F.translate(col, S.WIDE_SPACES, " " * len(S.WIDE_SPACES))


def straighten_quotes(col: Column) -> Column:
    return F.translate(col, S.CURLY_QUOTES, S.STRAIGHT_QUOTES)


def full_to_half_width(col: Column) -> Column:
    return F.translate(col, S.FULL_WIDTH, S.HALF_WIDTH)


def remove_special_chars(col: Column, letters: str = "a-zA-Z" + S.CJK_NARROW) -> Column:
    """Keep ``letters``, digits, whitespace and basic punctuation."""
    return F.regexp_replace(col, special_pattern(letters), "")


def special_pattern(letters: str) -> str:
    return f"[^{letters}0-9{SPACE}.,!?;:()\\[\\]{{}}\"'\\-]"


def remove_urls(col: Column) -> Column:
    return F.regexp_replace(col, S.URL_PATTERN, "")


def remove_emails(col: Column) -> Column:
    return F.regexp_replace(col, S.EMAIL_PATTERN, "")


def remove_numbers(col: Column) -> Column:
    return F.regexp_replace(col, "\\p{Nd}+", "")


def remove_chinese_marks(col: Column) -> Column:
    return F.translate(col, S.CHINESE_MARKS, "")


def remove_english_marks(col: Column) -> Column:
    return F.translate(col, S.ENGLISH_MARKS, "")


def trim_lines(col: Column) -> Column:
    # (?d) keeps \n the only line end; one regex stays inside code generation.
    return F.regexp_replace(col, f"(?dm)^[{INLINE}]+|[{INLINE}]+$", "")


def drop_blank_lines(col: Column) -> Column:
    return join_lines(F.filter(lines(col), lambda x: x.rlike(f"[^{SPACE}]")))


def drop_repeated_lines(col: Column) -> Column:
    """First occurrence kept, order kept."""
    return join_lines(F.array_distinct(lines(col)))


def apply_rules(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regex rules in order; a pattern that does not compile is skipped."""
    for pattern, replacement in rules:
        if not pattern:
            continue
        try:
            re.compile(pattern)
        except re.error:
            continue
        col = F.regexp_replace(col, pattern, replacement)
    return col


# The cleaning steps in their fixed order of application.
STEPS: list[tuple[str, Callable[[Column], Column]]] = [
    ("remove_html_tags", remove_html_tags),
    ("remove_whitespace", collapse_spaces),
    ("normalize_whitespace", normalize_spaces),
    ("normalize_quotes", straighten_quotes),
    ("convert_full_to_half", full_to_half_width),
    ("remove_special_chars", remove_special_chars),
    ("remove_urls", remove_urls),
    ("remove_emails", remove_emails),
    ("remove_numbers", remove_numbers),
    ("remove_chinese_punctuation", remove_chinese_marks),
    ("remove_english_punctuation", remove_english_marks),
    ("trim_lines", trim_lines),
    ("remove_empty_lines", drop_blank_lines),
    ("remove_duplicate_lines", drop_repeated_lines),
]


def clean(col: Column, config: S.CleaningConfig | str = "minimal") -> Column:
    """Apply a preset or a configuration."""
    if isinstance(config, str):
        config = S.CLEANING_PRESETS[config]
    for flag, step in STEPS:
        if getattr(config, flag):
            col = step(col)
    return apply_rules(col, config.custom_regex)


def html_to_text(col: Column) -> Column:
    """Readable text of a page: no scripts, styles, navigation, links or images."""
    col = F.regexp_replace(col, "(?is)<(script|style|nav|head|footer)\\b.*?</(script|style|nav|head|footer)>", "")
    col = F.regexp_replace(col, "(?s)<!--.*?-->", "")
    col = F.regexp_replace(col, "(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|section|blockquote)\\b[^>]*>", "\n")
    col = unescape_entities(F.regexp_replace(col, S.TAG_PATTERN, ""))
    return drop_blank_lines(trim_lines(collapse_spaces(col)))


def clean_corpus(
    col: Column,
    headers: Sequence[str] = S.HEADER_PHRASES,
    junk: Sequence[str] = S.JUNK_PHRASES,
    min_line: int = 5,
) -> Column:
    """Stricter cleaner for scanned or exported documents: page furniture, junk, stub lines."""
    col = F.regexp_replace(col, S.CONTROL_CHARS, "")
    col = F.regexp_replace(col, S.ZERO_WIDTH, "")
    col = F.regexp_replace(col, "[ \t]+", " ")
    col = trim_lines(F.regexp_replace(col, "\n{4,}", "\n\n\n"))
    for pattern in S.PAGE_FURNITURE:
        col = F.regexp_replace(col, pattern, "")
    for phrase in (*headers, *junk):
        col = F.replace(col, F.lit(phrase), F.lit(""))
    stripped = F.transform(lines(col), lambda x: F.regexp_replace(x, f"^[{INLINE}]+|[{INLINE}]+$", ""))
    kept = F.filter(
        stripped,
        lambda x: (F.length(x) >= min_line) | x.rlike(f"^[（(]?[0-9]+[）)]?[{INLINE}]*$"),
    )
    return strip(remove_urls(join_lines(kept)))


def clean_light(col: Column) -> Column:
    col = F.regexp_replace(col, "\n{3,}", "\n\n")
    for pattern in S.LIGHT_FURNITURE:
        col = F.regexp_replace(col, pattern, "")
    col = F.regexp_replace(col, S.CONTROL_CHARS, "")
    return strip(F.regexp_replace(col, "[ \t]+", " "))


def squash_spaces(col: Column) -> Column:
    return strip(F.regexp_replace(col, f"[{SPACE}]+", " "))


def cleaning_report(original: Column, cleaned: Column) -> Column:
    before, after = F.length(original), F.length(cleaned)
    return F.struct(
        before.alias("original_length"),
        after.alias("cleaned_length"),
        F.when(before > 0, F.round((before - after) / before * 100, 2)).otherwise(0.0).alias("reduction_pct"),
    )


def escape_html(col: Column) -> Column:
    for raw, safe in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")]:
        col = F.replace(col, F.lit(raw), F.lit(safe))
    return col


def quote_regex(col: Column) -> Column:
    return F.regexp_replace(col, "([.*+?^${}()|\\[\\]\\\\])", "\\\\$1")


def highlight(col: Column, keywords: Column, css: str = "highlight") -> Column:
    """Escape, then wrap each keyword occurrence in a span; ``keywords`` may differ per row."""
    escaped = escape_html(col)
    pattern = F.array_join(F.transform(keywords, quote_regex), "|")
    marked = F.regexp_replace(
        escaped, F.concat(F.lit("("), pattern, F.lit(")")), F.lit(f'<span class="{css}">$1</span>')
    )
    return F.when(F.size(keywords) > 0, marked).otherwise(escaped)


def similarity_band(col: Column) -> Column:
    return (
        F.when(col >= 0.8, "score-high")
        .when(col >= 0.7, "similarity-score")
        .when(col >= 0.6, "score-middle")
        .otherwise("score-low")
    )


def size_label(col: Column) -> Column:
    units = ["B", "KB", "MB", "GB", "TB"]
    label = None
    for power, unit in enumerate(units):
        text = F.format_string(f"%.2f {unit}", F.bround(col / float(1024**power), 2))
        if unit == "TB":
            return label.otherwise(text)
        test = col < float(1024 ** (power + 1))
        label = F.when(test, text) if label is None else label.when(test, text)


def preview(col: Column, size: int = 200, tail: str = "...") -> Column:
    return F.when(F.length(col) > size, F.concat(F.left(col, F.lit(size)), F.lit(tail))).otherwise(col)


def compress_middle(col: Column, limit: int = 2000, marker: str = "...（上下文已压缩）...") -> Column:
    half = F.lit(limit // 2)
    return F.when(F.length(col) > limit, F.concat(F.left(col, half), F.lit(marker), F.right(col, half))).otherwise(col)
