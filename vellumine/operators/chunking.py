"""Chunkers: one document row becomes an array of pieces, then rows.

A document is one row, so splitting it needs no shuffle. Pieces are found with look-ahead
splits and packed with an ordered fold that only records where each chunk starts; its cost is
linear in the pieces and no text is copied until the chunks are sliced out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumine import settings as S
from vellumine.functions import rules as R
from vellumine.functions import vectors as V
from vellumine.functions.text import char_class, filled, inside, let, outside, strip
from vellumine.functions.tokens import estimate_tokens

HARD_LIMIT = 2000
TABLE_BLOCK = "\\|[^\\n]+\\|\\n\\|[-:|\\s]+\\|\\n(?:\\|[^\\n]+\\|\\n?)+"
CODE_BLOCK = "```[\\s\\S]*?```"
NUMERALS = "零一二三四五六七八九十百千万\\d"
# A private-use character stands for a newline inside a protected block.
SHIELD = chr(0xE000)
ESCAPE = chr(0xE001)


# --- folds --------------------------------------------------------------------------------


def group_starts(pieces: Column, opens: Callable[[Column, Column], Column], join_cost: int = 0) -> Column:
    """1-based start of every group of an ordered piece array.

    ``opens(acc, piece)`` says whether the piece starts a new group; ``acc`` holds ``size``
    (sum of piece sizes plus ``join_cost`` per join) and ``last``, the previous piece. Every
    piece needs a ``size`` field.
    """
    empty = F.struct(
        F.array().cast("array<int>").alias("starts"),
        F.lit(0.0).alias("size"),
        F.lit(0).alias("i"),
        F.get(pieces, F.lit(0)).alias("last"),
    )

    def step(acc: Column, piece: Column) -> Column:
        new = (acc["i"] == 0) | opens(acc, piece)
        size = piece["size"].cast("double")
        return F.struct(
            F.when(new, F.array_append(acc["starts"], acc["i"] + 1)).otherwise(acc["starts"]).alias("starts"),
            F.when(new, size).otherwise(acc["size"] + size + join_cost).alias("size"),
            (acc["i"] + 1).alias("i"),
            piece.alias("last"),
        )

    return F.aggregate(pieces, empty, step, lambda acc: acc["starts"])


def slice_groups(pieces: Column, starts: Column) -> Column:
    """Array of piece arrays, one per group."""
    after = lambda i: F.coalesce(F.get(starts, i + 1), F.size(pieces) + 1)
    return F.transform(starts, lambda s, i: F.slice(pieces, s, after(i) - s))


def group_pieces(pieces: Column, opens, join_cost: int = 0) -> Column:
    return let(
        pieces, lambda ps: let(group_starts(ps, opens, join_cost), lambda starts: slice_groups(ps, starts))
    )


def join_text(group: Column, sep: str) -> Column:
    return F.array_join(F.transform(group, lambda p: p["text"]), sep)


def split_pieces(text: Column, mark: str) -> Column:
    """Text cut after every mark, marks kept: nothing is lost."""
    # No way back into a run: the last piece may have no mark.
    return F.regexp_extract_all(text, F.lit(f"{outside(mark)}++{inside(mark)}?|{inside(mark)}"), 0)


def split_before(text: Column, head: str) -> Column:
    """Text cut at newlines that precede ``head``; blank pieces dropped."""
    return F.filter(F.split(text, f"\\n(?={head})"), filled)


def protect(text: Column, *patterns: str) -> Column:
    """Hide newlines inside blocks that must stay whole, so no split falls into them.

    The shield character is escaped where the text itself has it.
    """
    text = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "1")), F.lit(SHIELD), F.lit(ESCAPE + "0"))
    for pattern in patterns:
        text = let(
            text,
            lambda t: F.aggregate(
                F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), 0)),
                t,
                lambda acc, block: F.replace(
                    acc,
                    block,
                    F.concat(
                        F.translate(F.regexp_replace(block, "\\n$", ""), "\n", SHIELD),
                        F.regexp_extract(block, "(\\n?)$", 1),
                    ),
                ),
            ),
        )
    return text


def restore(text: Column) -> Column:
    """Shielded newlines, and the text's own shield characters, as they were."""
    plain = F.replace(text, F.lit(SHIELD), F.lit("\n"))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "0"), F.lit(SHIELD)), F.lit(ESCAPE + "1"), F.lit(ESCAPE))


# --- size-based strategies ------------------------------------------------------------------


def fixed_windows(text: Column, size: int = 500, overlap: int = 50, keep: Callable[[Column], Column] = filled) -> Column:
    """array<struct<start, text>> of overlapping windows; those whose text ``keep`` rejects, by default blank ones, are dropped.

    The text is cut into steps, read once; a window is a step and the heads of those after it, as each substring would be
    counted from the text's start.
    """
    step = size - overlap

    def window(steps: Column, p: Column, i: Column) -> Column:
        heads = [F.coalesce(F.left(F.get(steps, i + j + 1), F.lit(min(step, overlap - j * step))), F.lit("")) for j in range(-(-overlap // step))]
        return F.struct((i * step).alias("start"), F.concat(p, *heads).alias("text"))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), 0)
    windows = let(pieces, lambda steps: F.transform(steps, lambda p, i: window(steps, p, i)))
    return F.filter(windows, lambda w: keep(w["text"]))


def force_split(text: Column, limit: int = HARD_LIMIT, marks: str = "。；！？\n") -> Column:
    """Pieces of at most ``limit`` characters, each cut moved back to its last sentence mark."""
    body = char_class(marks)
    pattern = f"(?s).{{1,{limit}}}\\z|.{{0,{limit - 1}}}[{body}]|.{{{limit}}}"
    pieces = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), strip)
    return F.filter(pieces, lambda p: p != "")


def naive_merge(text: Column, limit: int = 512, paragraph: str = "\\n\\s*\\n", marks: str = "。！？；\n") -> Column:
    """Paragraphs packed up to ``limit`` tokens; an oversize paragraph is packed by sentence.

    Tokens add up over pieces. Returns array<string>.
    """
    paragraphs = F.filter(F.transform(F.split(text, paragraph), strip), lambda p: p != "")

    def units(p: Column, i: Column) -> Column:
        def build(tokens: Column) -> Column:
            small = F.array(F.struct(p.alias("text"), tokens.alias("size"), F.lit(-1).alias("block")))
            cut = F.transform(
                split_pieces(p, marks),
                lambda s: F.struct(s.alias("text"), estimate_tokens(s).alias("size"), i.alias("block")),
            )
            return F.when(tokens > limit, cut).otherwise(small)

        return let(estimate_tokens(p), build)

    pieces = F.flatten(F.transform(paragraphs, units))
    opens = lambda acc, u: (u["block"] != acc["last"]["block"]) | (acc["size"] + u["size"] > limit)
    return F.transform(
        group_pieces(pieces, opens),
        lambda g: F.when(F.get(g, F.lit(0))["block"] == -1, join_text(g, "\n\n")).otherwise(join_text(g, "")),
    )


def token_chunks(
    text: Column, limit: int = 512, delimiters: str = "\n。；！？", overlap: float = 0.0, min_tokens: int = 8
) -> Column:
    """Documented token strategy: cut at delimiters, pack to ``limit`` tokens, repeat the tail
    of each chunk worth ``overlap`` of the limit in the next, drop chunks under ``min_tokens``."""
    pieces = F.transform(
        split_pieces(text, delimiters), lambda s: F.struct(s.alias("text"), estimate_tokens(s).alias("size"))
    )
    budget = limit * overlap

    def with_tail(ps: Column) -> Column:
        starts = group_starts(ps, lambda acc, u: acc["size"] + u["size"] > limit * (1 - overlap))

        def cut(starts: Column) -> Column:
            end = lambda i: F.coalesce(F.get(starts, i + 1), F.size(ps) + 1)

            def chunk(s: Column, i: Column) -> Column:
                # Walk back over the previous chunk while its tail fits the overlap budget.
                before = F.when(i > 0, F.reverse(F.slice(ps, F.get(starts, i - 1), s - F.get(starts, i - 1))))
                tail = F.aggregate(
                    F.coalesce(before, F.filter(ps, lambda p: F.lit(False))),
                    F.struct(F.lit(0.0).alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open")),
                    lambda acc, p: F.when(
                        acc["open"] & (acc["size"] + p["size"] <= budget),
                        F.struct(
                            (acc["size"] + p["size"]).alias("size"), (acc["n"] + 1).alias("n"), F.lit(True).alias("open")
                        ),
                    ).otherwise(F.struct(acc["size"].alias("size"), acc["n"].alias("n"), F.lit(False).alias("open"))),
                    lambda acc: acc["n"],
                )
                return let(tail, lambda n: join_text(F.slice(ps, s - n, end(i) - s + n), ""))

            return F.transform(starts, chunk)

        return let(starts, cut)

    return F.filter(let(pieces, with_tail), lambda c: estimate_tokens(c) >= min_tokens)


def sentence_windows(text: Column, size: int = 10, overlap: int = 2, marks: str = "。！？；.!?") -> Column:
    """``size`` sentences per chunk, ``overlap`` shared with the next."""
    body = char_class(marks)
    found = F.regexp_extract_all(text, F.lit(f"[^{body}]+[{body}]*"), 0)

    def windows(sentences: Column) -> Column:
        step = size - overlap
        starts = F.sequence(F.lit(1), F.greatest(F.size(sentences), F.lit(1)), F.lit(step))
        return F.transform(starts, lambda s: F.array_join(F.slice(sentences, s, size), ""))

    return F.filter(let(found, windows), filled)


def paragraphs(text: Column, delimiter: str = "\\n\\s*\\n") -> Column:
    return F.filter(F.transform(F.split(text, delimiter), strip), lambda p: p != "")


def custom_pieces(text: Column, delimiters: Sequence[str], children: Sequence[str] = ()) -> Column:
    """Cut at the main delimiters, then at the child delimiters inside each piece."""
    quoted = lambda ds: "|".join("\\Q" + d + "\\E" for d in ds)
    main = F.split(text, quoted(delimiters))
    if children:
        main = F.flatten(F.transform(main, lambda p: F.split(p, quoted(children))))
    return F.filter(F.transform(main, strip), lambda p: p != "")


def qa_pairs(text: Column) -> Column:
    """array<struct<question, answer>> of a question-and-answer document; text before the first question has none."""
    mark = f"(?:第[{NUMERALS}]+问|QUESTION\\s+[A-Z0-9]+|问题\\s*[:：]|Q\\d+\\s*[:：])"
    pieces = F.filter(F.split(text, f"(?m)(?=^{mark})"), filled)

    def pair(p: Column) -> Column:
        asked = p.rlike(f"^{mark}")
        first = F.regexp_extract(p, f"^{mark}[\\s:：.、]*([^\\n]*)", 1)
        rest = F.when(asked, F.regexp_replace(p, "^[^\\n]*\\n?", "")).otherwise(p)
        return F.struct(
            strip(first).alias("question"),
            F.regexp_replace(strip(rest), "^(?:答案?|A\\d*|ANSWER)\\s*[:：]\\s*", "").alias("answer"),
        )

    return F.transform(pieces, pair)


# Heading marks of the outline strategies.
HEADING_MARKS = {
    "paper": f"#{{1,6}}\\s|第[{NUMERALS}]+[章节]|\\d+(?:\\.\\d+)+\\s|CHAPTER\\b|SECTION\\b|ABSTRACT\\b|INTRODUCTION\\b",
    "laws": f"第[{NUMERALS}]+[章节条]|[（(]\\d+[)）]|[一二三四五六七八九十]+、",
    "book": f"第[{NUMERALS}]+[章节]|PART\\s+[A-Z]+|Chapter\\s+[IVXLC\\d]+|Section\\s+\\d+",
    "markdown": "#{1,6}\\s",
}


def heading_sections(text: Column, marks: str = HEADING_MARKS["markdown"], indent: str = "[ \\t]*", title: str | None = None) -> Column:
    """array<struct<title, content>>: the content of a section includes its heading line.

    ``indent`` may stand before a heading. A first line is the title if its stripped text begins with ``marks``, or else if the
    line as it stands begins with ``title``.
    """
    pieces = F.filter(F.split(text, f"\\n(?={indent}(?:{marks}))"), filled)

    def section(p: Column) -> Column:
        line = F.substring_index(p, "\n", 1)
        titled = strip(line).rlike(f"^(?:{marks})") if title is None else line.rlike(f"^(?:{title})")
        return F.struct(F.when(titled, strip(line)).otherwise("").alias("title"), strip(p).alias("content"))

    return F.transform(pieces, section)


def outline(text: Column, title="#\\s+", chapter="##\\s+", section="###\\s+") -> Column:
    """array<struct<pos, level, title>>: headings of three levels with their character offset."""

    def mark(line: Column, offset: Column) -> Column:
        level = (
            F.when(line.rlike(f"^(?:{section})"), 3)
            .when(line.rlike(f"^(?:{chapter})"), 2)
            .when(line.rlike(f"^(?:{title})"), 1)
        )
        name = strip(F.regexp_replace(F.regexp_replace(line, "^#+\\s*", ""), "\\s+", " "))
        return F.struct(offset.alias("pos"), level.alias("level"), name.alias("title"))

    def headings(ls: Column) -> Column:
        folded = F.aggregate(
            ls,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<pos:int,level:int,title:string>>").alias("found")),
            lambda acc, line: F.struct(
                (acc["at"] + F.length(line) + 1).alias("at"),
                F.when(line.rlike("^#"), F.array_append(acc["found"], mark(line, acc["at"]))).otherwise(acc["found"]).alias("found"),
            ),
            lambda acc: acc["found"],
        )
        return F.filter(folded, lambda h: h["level"].isNotNull())

    return headings(F.split(text, "\n"))


def table_chunks(text: Column, context: int = 0) -> Column:
    """array<struct<kind, text>>: each Markdown or HTML table alone, the rest by paragraph, in order.

    ``context`` characters of the neighbouring text may be put before and after a table.
    """
    block = f"(?s)<table\\b.*?</table>|{TABLE_BLOCK}"
    shielded = protect(text, block)
    spaced = F.regexp_replace(shielded, f"(<table\\b[^\\n]*</table>|\\|[^\\n]*{SHIELD}[^\\n]*\\|)", "\n\n$1\n\n")
    parts = paragraphs(spaced)
    is_table = lambda p: p.contains(SHIELD) | p.rlike("^<table\\b")

    def emit(ps: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            before = F.when(i > 0, F.right(F.get(ps, i - 1), F.lit(context)))
            after = F.left(F.get(ps, i + 1), F.lit(context))
            framed = F.concat_ws("\n\n", before, p, after) if context else p
            return F.struct(
                F.when(is_table(p), "table").otherwise("text").alias("kind"),
                restore(F.when(is_table(p), framed).otherwise(p)).alias("text"),
            )

        return F.transform(ps, one)

    return let(parts, emit)


# --- merging --------------------------------------------------------------------------------


def merge_small(chunks: Column, min_chars: int = 500) -> Column:
    """Append the next chunk while the current one is shorter than ``min_chars``.

    ``chunks`` is array<struct<text, size, ...>>; the first chunk's other fields are kept.
    """
    return _merge(chunks, lambda acc, c: acc["size"] >= min_chars)


def _merge(chunks: Column, opens) -> Column:
    def fuse(g: Column) -> Column:
        return let(F.get(g, F.lit(0)), lambda head: head.withField("text", join_text(g, "\n\n")))

    return F.transform(group_pieces(chunks, opens, join_cost=2), fuse)


# --- document types -------------------------------------------------------------------------


def _chunk(text: Column, kind: Column | str, section: Column, sub: Column | None = None) -> Column:
    return let(
        strip(text),
        lambda body: F.struct(
            body.alias("text"),
            F.length(body).alias("size"),
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"),
            section.alias("section"),
            (F.lit("") if sub is None else sub).alias("subsection"),
        ),
    )


def _heading(text: Column, level: int) -> Column:
    return strip(F.regexp_extract(text, f"(?m)^{'#' * level}\\s+(.+)$", 1))


def _by_section(text: Column, expand: Callable[[Column, Column], Column], kind: str, limit: int) -> Column:
    """``##`` sections; those longer than ``limit`` are expanded by ``expand(section, title)``."""

    def section(s: Column) -> Column:
        # Bound, as is every heading below: inside a lambda its section would be searched again for each chunk.
        return let(
            _heading(s, 2),
            lambda title: F.when(F.length(s) > limit, expand(s, title)).otherwise(F.array(_chunk(s, kind, title))),
        )

    return F.flatten(F.transform(split_before(text, "##\\s+"), section))


def product_chunks(text: Column, limit: int = HARD_LIMIT) -> Column:
    """``##``, then ``###``, then paragraphs with a two-paragraph overlap; short chunks merged."""

    def paragraphs_of(part: Column, title: Column, sub: Column) -> Column:
        ps = F.transform(F.split(part, "\\n\\n"), lambda p: F.struct(p.alias("text"), F.length(p).alias("size")))

        def overlapped(ps: Column) -> Column:
            starts = group_starts(ps, lambda acc, p: acc["size"] + p["size"] > limit)

            def cut(starts: Column) -> Column:
                def piece(s: Column, i: Column) -> Column:
                    back = F.when(i > 0, F.least(F.lit(2), s - F.get(starts, i - 1))).otherwise(0)
                    end = F.coalesce(F.get(starts, i + 1), F.size(ps) + 1)
                    return _chunk(
                        join_text(F.slice(ps, s - back, end - s + back), "\n\n"), "product_paragraph", title, sub
                    )

                return F.transform(starts, piece)

            return let(starts, cut)

        return let(ps, overlapped)

    def expand(section: Column, title: Column) -> Column:
        def part(p: Column) -> Column:
            return let(
                _heading(p, 3),
                lambda sub: F.when(F.length(p) > limit, paragraphs_of(p, title, sub)).otherwise(
                    F.array(_chunk(p, "product_section", title, sub))
                ),
            )

        return F.flatten(F.transform(split_before(section, "###\\s+"), part))

    return merge_small(_by_section(text, expand, "product_section", limit), 300)


def technical_chunks(text: Column, limit: int = HARD_LIMIT) -> Column:
    """Code blocks and tables stay whole; long ``##`` sections split at ``###`` or HTTP routes."""
    verb = "(?:GET|POST|PUT|DELETE|PATCH)\\s+/"

    def expand(section: Column, title: Column) -> Column:
        pieces = F.transform(
            split_before(section, f"###\\s+|{verb}"), lambda p: F.struct(p.alias("text"), F.length(p).alias("size"))
        )
        fresh = lambda p: p["text"].rlike(f"^\\s*(?:###\\s+|{verb})")
        opens = lambda acc, p: (fresh(p) & (acc["size"] > 500)) | (acc["size"] > limit)
        groups = F.transform(group_pieces(pieces, opens), lambda g: join_text(g, "\n"))
        return F.transform(
            groups,
            lambda t: _chunk(t, F.when(t.rlike(verb), "api_endpoint").otherwise("tech_subsection"), title, _heading(t, 3)),
        )

    return _unshield(_by_section(protect(text, CODE_BLOCK, TABLE_BLOCK), expand, "tech_section", limit))


def _unshield(chunks: Column) -> Column:
    return F.transform(chunks, lambda c: c.withField("text", restore(c["text"])))


def article_chunks(
    text: Column,
    chapter: str = f"(?:#{{1,2}}\\s*)?第[{NUMERALS}]+章",
    article: str = f"(?:#{{1,6}}\\s*)?第[{NUMERALS}]+条",
    limit: int = HARD_LIMIT,
    pack: int = 1500,
    short: int = 300,
    marks: str = "。；！？\n",
    pack_by: Callable[[Column], Column] = F.length,
    name: str = "compliance_article",
) -> Column:
    """Chapter, then article; long articles packed by sentence, adjacent short ones merged.

    Serves the compliance and the hybrid strategies, which differ in names and in what
    ``pack`` measures (characters or tokens). Text before the first chapter or article is
    kept as its own piece. ``articles`` lists the article numbers of a chunk.
    """
    number = f"^(?:#{{1,6}}\\s*)?第([{NUMERALS}]+)条"

    def piece(content: Column, kind: str, title: Column, numbers: Column, sub: Column) -> Column:
        return let(
            strip(content),
            lambda body: F.struct(
                body.alias("text"), F.length(body).alias("size"), F.lit(kind).alias("kind"), title.alias("chapter"),
                numbers.alias("articles"), sub.alias("sub_index"), body.contains(SHIELD).alias("has_table"),
            ),
        )

    def articles_of(ch: Column) -> Column:
        head = strip(F.substring_index(strip(ch), "\n", 1))
        named = let(head, lambda h: F.when(h.rlike(f"^(?:{chapter})"), h).otherwise(""))
        return let(named, lambda title: F.flatten(F.transform(split_before(ch, article), lambda a: let(strip(a), article_of(title)))))

    def article_of(title: Column) -> Callable[[Column], Column]:
        def one(a: Column) -> Column:
            found = F.when(a.rlike(number), F.array(F.regexp_extract(a, number, 1))).otherwise(F.array().cast("array<string>"))
            sentences = F.transform(split_pieces(a, marks), lambda s: F.struct(s.alias("text"), pack_by(s).alias("size")))
            groups = group_pieces(sentences, lambda acc, s: acc["size"] + s["size"] > pack)
            return let(
                found,
                lambda numbers: F.when(
                    F.length(a) > limit,
                    F.transform(groups, lambda g, i: piece(join_text(g, ""), f"{name}_split", title, numbers, i)),
                ).otherwise(F.array(piece(a, name, title, numbers, F.lit(None).cast("int")))),
            )

        return one

    chunks = F.flatten(F.transform(split_before(protect(text, TABLE_BLOCK), chapter), articles_of))

    def opens(acc: Column, c: Column) -> Column:
        same = (c["chapter"] == acc["last"]["chapter"]) & (c["kind"] == acc["last"]["kind"])
        return ~(same & (acc["size"] < short) & (c["size"] < short))

    def fuse(g: Column) -> Column:
        return let(
            F.get(g, F.lit(0)),
            lambda head: head.withField("text", restore(join_text(g, "\n\n"))).withField(
                "articles", F.flatten(F.transform(g, lambda c: c["articles"]))
            ),
        )

    return F.transform(group_pieces(chunks, opens, join_cost=2), fuse)


def hybrid_chunks(text: Column) -> Column:
    return article_chunks(
        text, chapter=f"(?:##\\s*)?第[{NUMERALS}]+章", article=f"第[{NUMERALS}]+条",
        pack_by=estimate_tokens, name="hybrid_article",
    )


def hr_chunks(text: Column, limit: int = HARD_LIMIT) -> Column:
    """``##``; long sections split at article or numbered ``###`` headings; merged under 400."""
    article = f"#{{3,4}}\\s*(?:第[{NUMERALS}]+条|\\d+\\.)"

    def expand(section: Column, title: Column) -> Column:
        def part(p: Column) -> Column:
            sub = F.when(p.rlike(f"^{article}"), strip(F.substring_index(p, "\n", 1))).otherwise("")
            # An article over the limit is cut again so that no chunk exceeds it.
            return let(sub, lambda sub: F.transform(force_split(p, limit), lambda t: _chunk(t, "hr_article", title, sub)))

        return F.flatten(F.transform(split_before(section, article), part))

    return _unshield(merge_small(_by_section(protect(text, TABLE_BLOCK), expand, "hr_section", limit), 400))


def project_chunks(text: Column, limit: int = HARD_LIMIT) -> Column:
    """Chapter or phase headings, ``###``, then numbered steps packed to ``limit``; merged under 400."""
    chapter = f"#{{1,2}}\\s*(?:第[{NUMERALS}]+章|流程|阶段)"
    step = "Step\\s+\\d+|步骤\\s*\\d+|\\d+\\.\\s+"
    checklist = "(?m)^(?:(?:[^\\n\\[]++|\\[(?![ x]\\]))*+\\[[ x]\\][^\\n]*+(?:\\n|\\z)){2,}+"

    def part(title: Column) -> Callable[[Column], Column]:
        def build(p: Column) -> Column:
            steps = F.transform(split_before(p, step), lambda s: F.struct(s.alias("text"), F.length(s).alias("size")))
            groups = group_pieces(steps, lambda acc, s: acc["size"] + s["size"] > limit)
            return let(
                _heading(p, 3),
                lambda sub: F.when(
                    F.length(p) > limit, F.transform(groups, lambda g: _chunk(join_text(g, "\n"), "pm_step", title, sub))
                ).otherwise(F.array(_chunk(p, "pm_section", title, sub))),
            )

        return build

    def chapter_of(c: Column) -> Column:
        first = strip(F.substring_index(c, "\n", 1))
        named = let(first, lambda f: F.when(f.rlike(f"^{chapter}"), f).otherwise(""))
        return let(named, lambda title: F.flatten(F.transform(split_before(c, "###\\s+"), part(title))))

    shielded = protect(text, CODE_BLOCK, checklist)
    return _unshield(merge_small(F.flatten(F.transform(split_before(shielded, chapter), chapter_of)), 400))


def policy_chunks(text: Column, short_first: int = 800, short_last: int = 200) -> Column:
    """Policy documents: title with chapter one; each later chapter heading merged with its first
    section when that has a table or is short; a short last section merged back. Every
    character lies in exactly one chunk."""
    chapter, section = f"##\\s*第[{NUMERALS}]+章", "###\\s*[0-9]+\\.[0-9]+"
    pieces = split_before(protect(text, TABLE_BLOCK), chapter)
    title_of = lambda p: strip(F.regexp_replace(F.substring_index(strip(p), "\n", 1), "^#+\\s*", ""))

    def sections_of(ch: Column, number: Column) -> Column:
        parts = split_before(ch, section)

        def glue(ps: Column, heading: Column) -> Column:
            last = F.size(ps) - 1

            def one(p: Column, j: Column) -> Column:
                joined = F.when(j == 1, p.contains(SHIELD) | (F.length(p) < short_first)).otherwise(False)
                tail = (j == last) & (j > 1) & (F.length(p) < short_last)
                return F.struct(
                    p.alias("text"), F.length(p).alias("size"), (joined | tail).alias("glued"),
                    number.alias("chapter_index"), heading.alias("chapter"), title_of(p).alias("title"),
                    j.alias("section_index"), F.size(ps).alias("parts"),
                )

            return F.transform(ps, one)

        return let(title_of(ch), lambda heading: let(parts, lambda ps: glue(ps, heading)))

    def body(ps: Column) -> Column:
        # The preamble belongs to chapter one, which stays one chunk with all its sections.
        preamble = F.when(F.get(ps, F.lit(0)).rlike(f"^\\s*{chapter}"), 0).otherwise(1)
        head = F.slice(ps, 1, preamble + 1)
        first = F.struct(
            F.array_join(head, "\n").alias("text"), F.length(F.array_join(head, "\n")).alias("size"),
            F.lit(False).alias("glued"), F.lit(1).alias("chapter_index"),
            title_of(F.get(ps, preamble)).alias("chapter"), title_of(F.get(ps, preamble)).alias("title"),
            F.lit(0).alias("section_index"), F.lit(1).alias("parts"),
        )
        rest = F.slice(ps, preamble + 2, F.size(ps))
        later = F.flatten(F.transform(rest, lambda c, i: sections_of(c, i + 2)))
        return F.concat(F.array(first), later)

    def finish(g: Column) -> Column:
        def build(head: Column) -> Column:
            kind = (
                F.when(head["parts"] == 1, "chapter")
                .when((head["section_index"] == 0) & (F.size(g) > 1), "chapter_section")
                .when(head["section_index"] == 0, "chapter_title")
                .otherwise("section")
            )
            joined = restore(strip(join_text(g, "\n")))
            return F.struct(
                joined.alias("text"), F.length(joined).alias("size"), kind.alias("kind"),
                F.array_distinct(F.concat(F.array(head["chapter"]), F.transform(g, lambda p: p["title"]))).alias("hierarchy_path"),
                head["chapter_index"].alias("chapter_index"), joined.rlike(TABLE_BLOCK).alias("has_table"),
            )

        return let(F.get(g, F.lit(0)), build)

    return F.transform(group_pieces(let(pieces, body), lambda acc, p: ~p["glued"], join_cost=1), finish)


def expense_chunks(text: Column, levels=S.LEVEL_TABLE_ROWS, level_words=S.LEVEL_TABLE_WORDS) -> Column:
    """Expense policies: ``#`` then ``##``; tables become chunks with the text around them, and a
    table that differs by job level becomes one chunk per level with the matching rows."""
    row_sep = SHIELD

    def tagged(content: Column, kind: str, section: Column, sub: Column, level: Column | None = None) -> Column:
        return let(
            strip(content),
            lambda body: F.struct(
                restore(body).alias("text"), F.length(body).alias("size"), F.lit(kind).alias("kind"),
                section.alias("section"), sub.alias("subsection"),
                (R.level_tags(body) if level is None else level).alias("level"),
                R.expense_tags(body).alias("expense_type"),
            ),
        )

    def level_tables(section, sub, table, context, intro) -> Column:
        rows = F.filter(F.split(table, row_sep), lambda r: strip(r) != "")

        def build(rs: Column) -> Column:
            every = [w for words in levels.values() for w in words]

            def one(name: str, words: Sequence[str] | None) -> Column:
                kept = F.filter(F.slice(rs, 3, F.size(rs)), lambda r: ~R.any_of(r, every) if words is None else R.any_of(r, words))
                grid = F.concat_ws("\n", F.get(rs, F.lit(0)), F.get(rs, F.lit(1)), F.array_join(kept, "\n"))
                parts = F.concat_ws(
                    "\n\n", F.concat(F.lit("# "), section), F.when(intro != "", intro),
                    F.concat(F.lit("## "), sub, F.lit(f" - {name}")), context, grid,
                )
                return F.when(F.size(kept) > 0, tagged(parts, "table", section, sub, F.lit(name)))

            # Rows that name no level are a chunk of their own.
            return F.array_compact(F.array(*[one(n, w) for n, w in levels.items()], one("其他", None)))

        return let(rows, build)

    def leveled(p: Column) -> Column:
        rows = F.filter(F.split(p, row_sep), lambda r: strip(r) != "")
        return R.any_of(p, level_words) & (F.size(rows) >= 3)

    def subsection(section: Column, intro: Column) -> Callable[[Column], Column]:
        def build(s: Column) -> Column:
            sub = _heading(s, 2)
            content = strip(F.regexp_replace(s, "^\\s*##[^\\n]*\\n?", ""))
            head = F.concat(F.lit("# "), section, F.lit("\n\n## "), sub, F.lit("\n\n"))
            parts = F.split(content, f"\\n(?=\\|[^\\n]*{SHIELD})|(?<=\\|)\\n(?!\\|)")

            def emit(ps: Column) -> Column:
                def one(p: Column, i: Column) -> Column:
                    is_table = p.contains(SHIELD)
                    before = strip(F.when(i > 0, F.get(ps, i - 1)).otherwise(""))
                    after = strip(F.coalesce(F.get(ps, i + 1), F.lit("")))
                    framed = F.concat(head, before, F.lit("\n\n"), p, F.lit("\n\n"), after)
                    by_level = leveled(p)
                    # Text that no table's chunk has taken in is a chunk of its own: a plain table takes both
                    # neighbours, a table by level only the one before it.
                    last = F.when(i > 0, F.get(ps, i - 1)).otherwise("")
                    beside = F.coalesce(F.get(ps, i + 1), F.lit("")).contains(SHIELD) | (
                        last.contains(SHIELD) & ~leveled(last)
                    )
                    return (
                        F.when(is_table & by_level, level_tables(section, sub, p, before, intro))
                        .when(is_table, F.array(tagged(framed, "table", section, sub)))
                        .when((strip(p) != "") & ~beside, F.array(tagged(F.concat(head, p), "text", section, sub)))
                        .otherwise(F.filter(F.array(tagged(p, "text", section, sub)), lambda c: F.lit(False)))
                    )

                return F.flatten(F.transform(ps, one))

            return let(parts, emit)

        return build

    def section_of(s: Column) -> Column:
        return let(
            F.struct(_heading(s, 1).alias("title"), strip(F.regexp_replace(s, "^\\s*#[ \\t][^\\n]*\\n?", "")).alias("body")),
            lambda x: parts_of(x["title"], x["body"]),
        )

    def parts_of(title: Column, content: Column) -> Column:
        intro = strip(F.regexp_extract(content, "(?s)^([^#].*?)(?=\\n##|\\z)", 1))
        subs = F.filter(F.split(content, "\\n?(?=##[ \\t])"), lambda p: p.rlike("^##[ \\t]"))
        whole = F.array(tagged(F.concat(F.lit("# "), title, F.lit("\n\n"), content), "text", title, F.lit("")))
        lead = F.filter(F.array(tagged(F.concat(F.lit("# "), title, F.lit("\n\n"), intro), "text", title, F.lit(""))), lambda c: intro != "")
        split = F.concat(lead, F.flatten(F.transform(subs, subsection(title, intro))))
        return F.when(F.size(subs) > 0, split).otherwise(whole)

    shielded = protect(text, TABLE_BLOCK)
    return F.flatten(F.transform(split_before(shielded, "#[ \\t]"), section_of))


def expense_chunks_legacy(text: Column, limit: int = 800) -> Column:
    """First expense strategy: table, procedure and text sections; long text packed by paragraph
    with the last three lines repeated."""
    levels = S.LEGACY_LEVEL_WORDS
    all_words = [w for ws in levels.values() for w in ws]

    def tag(content: Column, kind: str, title: Column, level: Column | None = None) -> Column:
        return let(
            strip(content),
            lambda body: F.struct(
                restore(body).alias("text"), F.length(body).alias("size"), F.lit(kind).alias("kind"), title.alias("section"),
                (R.all_labels(body, levels) if level is None else level).alias("level"),
                R.all_labels(body, S.LEGACY_EXPENSE_WORDS).alias("expense_type"),
            ),
        )

    def text_part(title: Column) -> Callable[[Column], Column]:
        head = F.concat(F.lit("## "), title, F.lit("\n\n"))

        def build(p: Column) -> Column:
            ps = F.transform(
                F.filter(F.transform(F.split(p, "\\n\\n"), strip), lambda x: x != ""),
                lambda x: F.struct(x.alias("text"), (F.length(x) + 2).alias("size")),
            )

            def packed(ps: Column) -> Column:
                starts = group_starts(ps, lambda acc, x: acc["size"] + x["size"] + F.length(head) > limit)

                def cut(groups: Column) -> Column:
                    def one(g: Column, i: Column) -> Column:
                        tail_lines = F.split(join_text(F.get(groups, i - 1), "\n\n"), "\n")
                        keep = F.when(F.size(tail_lines) > 3, 3).when(F.size(tail_lines) > 1, 2).otherwise(0)
                        tail = F.array_join(F.slice(tail_lines, F.size(tail_lines) - keep + 1, keep), "\n")
                        lead = F.when((i > 0) & (keep > 0), F.concat(tail, F.lit("\n\n"))).otherwise("")
                        return tag(F.concat(head, lead, join_text(g, "\n\n")), "text", title)

                    return F.transform(groups, one)

                return let(slice_groups(ps, starts), cut)

            return F.when(F.length(p) > limit, let(ps, packed)).otherwise(
                F.array(tag(F.concat(head, strip(p)), "text", title))
            )

        return build

    def texts(title: Column, content: Column) -> Column:
        parts = F.filter(F.split(content, "\\n##\\s+"), lambda p: strip(p) != "")
        return F.flatten(F.transform(parts, text_part(title)))

    def tables(title: Column, content: Column) -> Column:
        found = F.regexp_extract_all(content, F.lit(f"\\|[^\\n]*{SHIELD}[^\\n]*\\|"), 0)

        def one(t: Column) -> Column:
            rows = F.split(t, SHIELD)

            def by_level(name: str, words: Sequence[str] | None) -> Column:
                held = lambda r: ~R.any_of(r, all_words) & (strip(r) != "") if words is None else R.any_of(r, words)
                kept = F.filter(F.slice(rows, 3, F.size(rows)), held)
                notes = F.filter(F.split(content, "\\n\\n"), lambda p: held(p) & p.rlike("注：|说明：|注意") & ~p.contains(SHIELD))
                grid = F.concat_ws("\n", F.get(rows, F.lit(0)), F.get(rows, F.lit(1)), F.array_join(kept, "\n"))
                body = F.concat(
                    F.lit("## "), title, F.lit(f" - {name}\n\n"), F.array_join(F.transform(notes, strip), "\n"), F.lit("\n\n"), grid
                )
                return F.when(F.size(kept) > 0, tag(body, "table", title, F.lit(name)))

            expanded = F.array_compact(F.array(*[by_level(n, w) for n, w in levels.items()], by_level("其他", None)))
            plain = F.array(tag(F.concat(F.lit("## "), title, F.lit("\n\n"), t), "table", title))
            return F.when(R.any_of(t, S.LEVEL_TABLE_WORDS) & (F.size(rows) >= 3), expanded).otherwise(plain)

        rest = F.regexp_replace(content, f"\\|[^\\n]*{SHIELD}[^\\n]*\\|", "")
        return F.concat(F.flatten(F.transform(found, one)), texts(title, rest))

    def section_of(s: Column) -> Column:
        return let(
            F.struct(_heading(s, 1).alias("title"), strip(F.regexp_replace(s, "^\\s*#[ \\t][^\\n]*\\n?", "")).alias("body")),
            lambda x: parts_of(x["title"], x["body"]),
        )

    def parts_of(title: Column, content: Column) -> Column:
        has_table = content.contains(SHIELD) & R.any_of(content, all_words)
        steps = R.any_of(content, ["流程", "步骤", "审批流", "申请人", "审批"]) & content.rlike("→|```")
        return (
            F.when(has_table, tables(title, content))
            .when(steps, F.array(tag(F.concat(F.lit("## "), title, F.lit("\n\n"), content), "procedure", title)))
            .otherwise(texts(title, content))
        )

    return F.flatten(F.transform(split_before(protect(text, TABLE_BLOCK), "#[ \\t]"), section_of))


# --- semantic chunks ------------------------------------------------------------------------


def semantic_groups(units: Column, threshold: float = 0.8) -> Column:
    """Greedy semantic chunks of ordered units array<struct<text, chapter, vector, ...>>.

    A unit joins when its mean cosine to all members is at least ``threshold``. With unit
    vectors the mean is one dot product with the running member sum. Returns
    array<struct<start, members, avg_similarity>>.
    """
    blank = F.array().cast("array<struct<start:int,members:int,similarity:double>>")
    start = F.struct(
        blank.alias("done"), F.array().cast("array<double>").alias("total"), F.lit(0).alias("n"),
        F.lit(0.0).alias("sims"), F.lit(0).alias("i"), F.lit(None).cast("string").alias("chapter"),
    )
    close = lambda acc: F.array_append(
        acc["done"],
        F.struct(
            (acc["i"] - acc["n"] + 1).alias("start"), acc["n"].alias("members"),
            F.when(acc["n"] > 1, acc["sims"] / (acc["n"] - 1)).otherwise(1.0).alias("similarity"),
        ),
    )

    def step(acc: Column, u: Column) -> Column:
        def decide(sim: Column) -> Column:
            joins = (acc["n"] > 0) & (u["chapter"] == acc["chapter"]) & (sim >= threshold)
            return F.struct(
                F.when(joins | (acc["n"] == 0), acc["done"]).otherwise(close(acc)).alias("done"),
                F.when(joins, F.zip_with(acc["total"], u["vector"], lambda a, b: a + b)).otherwise(u["vector"]).alias("total"),
                F.when(joins, acc["n"] + 1).otherwise(1).alias("n"),
                F.when(joins, acc["sims"] + sim).otherwise(0.0).alias("sims"),
                (acc["i"] + 1).alias("i"),
                u["chapter"].alias("chapter"),
            )

        return let(F.when(acc["n"] > 0, V.dot(acc["total"], u["vector"]) / acc["n"]).otherwise(0.0), decide)

    return F.aggregate(units, start, step, lambda acc: F.when(acc["n"] > 0, close(acc)).otherwise(acc["done"]))


# --- rows -----------------------------------------------------------------------------------


def to_rows(docs: DataFrame, chunks: Column, key: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """Chunk rows ``{key}_chunk_{n}`` with number, content and length from a chunk array."""
    # The outer form keeps the optimizer from adding a size filter that would split twice.
    rows = docs.select(key, *keep, F.posexplode_outer(chunks).alias("_pos", "_chunk")).where("_pos IS NOT NULL")
    kind = rows.schema["_chunk"].dataType.simpleString()
    content = strip(F.col("_chunk.text") if kind.startswith("struct") else F.col("_chunk"))
    extra = []
    if kind.startswith("struct"):
        extra = [F.col(f"_chunk.{f}").alias(f) for f in rows.schema["_chunk"].dataType.names if f not in ("text", "size")]
    return rows.select(
        key, *keep,
        F.format_string(f"%s_chunk_%d", F.col(key), F.col("_pos") + 1).alias("chunk_id"),
        (F.col("_pos") + 1).cast("bigint").alias("num"),
        content.alias("content"),
        F.length(content).alias("length"),
        *extra,
    )


def enforce_limit(chunks: DataFrame, limit: int = HARD_LIMIT) -> DataFrame:
    """Cut chunks over the hard limit; the cut rows carry forced_split and sub_chunk_index."""
    parts = F.when(F.length("content") > limit, force_split(F.col("content"), limit)).otherwise(F.array("content"))
    rows = chunks.withColumn("forced_split", F.length("content") > limit)
    rest = [c for c in rows.columns if c not in ("content", "length")]
    return rows.select(*rest, F.posexplode(parts).alias("sub_chunk_index", "content")).withColumn(
        "length", F.length("content")
    ).withColumn("sub_chunk_index", F.when(F.col("forced_split"), F.col("sub_chunk_index")))


def secondary_split(text: Column, limit: int = HARD_LIMIT, preferred: int = 1500) -> Column:
    """Long section to pieces: headings first, packed to ``preferred``, never over ``limit``."""
    parts = F.transform(
        F.split(text, "\\n(?=#{2,6}\\s)"), lambda p: F.struct(p.alias("text"), F.length(p).alias("size"))
    )
    packed = group_pieces(parts, lambda acc, p: acc["size"] + p["size"] > preferred, join_cost=1)
    return F.flatten(F.transform(packed, lambda g: let(join_text(g, "\n"), lambda t: F.when(F.length(t) > limit, force_split(t, limit)).otherwise(F.array(t)))))


STRATEGIES: dict[str, Callable[[Column], Column]] = {
    "naive": naive_merge,
    "token": token_chunks,
    "char": lambda t: F.transform(fixed_windows(t), lambda w: w["text"]),
    "sentence": sentence_windows,
    "paragraph": paragraphs,
    "table": lambda t: F.transform(table_chunks(t), lambda c: c["text"]),
    "qa": lambda t: F.transform(qa_pairs(t), lambda p: F.concat_ws("\n", p["question"], p["answer"])),
    "policy": lambda t: F.transform(policy_chunks(t), lambda c: c["text"]),
    "financial": lambda t: F.transform(expense_chunks(t), lambda c: c["text"]),
    "product": lambda t: F.transform(product_chunks(t), lambda c: c["text"]),
    "technical": lambda t: F.transform(technical_chunks(t), lambda c: c["text"]),
    "compliance": lambda t: F.transform(article_chunks(t), lambda c: c["text"]),
    "hybrid": lambda t: F.transform(hybrid_chunks(t), lambda c: c["text"]),
    "hr": lambda t: F.transform(hr_chunks(t), lambda c: c["text"]),
    "project": lambda t: F.transform(project_chunks(t), lambda c: c["text"]),
    "secondary": secondary_split,
    **{
        name: (lambda marks: lambda t: F.transform(heading_sections(t, marks), lambda s: s["content"]))(HEADING_MARKS[name])
        for name in ("paper", "laws", "book")
    },
}


def dispatch(
    docs: DataFrame, strategy: str = "strategy", text: str = "text", key: str = "doc_id",
    delimiters: Sequence[str] = ("\n\n",), children: Sequence[str] = (),
) -> DataFrame:
    """Chunk each document by its strategy column, in one scan.

    One conditional expression holds all strategies, so a row evaluates only its own; ``custom`` cuts at the given
    delimiters. Unknown strategies and empty results fall back to naive; documents without text become error rows.
    """
    strategies = {**STRATEGIES, "custom": lambda t: custom_pieces(t, delimiters, children)}
    usable = F.coalesce(strip(F.col(text)), F.lit("")) != ""
    known = F.when(F.col(strategy).isin(*strategies), F.col(strategy)).otherwise("naive")
    found = None
    for name, fn in strategies.items():
        test = usable & (F.col("used_strategy") == name)
        found = F.when(test, fn(F.col(text))) if found is None else found.when(test, fn(F.col(text)))
    chunked = let(found, lambda c: F.when(F.size(c) > 0, c).when(usable, F.array(F.col(text))).otherwise(F.array(F.lit(""))))
    rows = to_rows(docs.withColumn("used_strategy", known), chunked, key, ["used_strategy"])
    return rows.withColumn("error", F.when(F.col("content") == "", "empty document"))
