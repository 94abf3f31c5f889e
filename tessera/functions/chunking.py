"""Chunkers as column expressions.

Each function turns one text column into ``ARRAY<STRUCT>`` of chunks, using only
built-in expressions, so that chunking is a projection plus ``explode``: no
shuffle and no Python worker. Line numbers are 1-based and inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import is_blank, join_lines, let, lines_of, trim_space

CHUNK_ARRAY = (
    "array<struct<content:string,start_line:int,end_line:int,chunk_type:string,divisible:boolean>>"
)

# Line-start patterns that open a code segment, per language.
# ``\s`` is spelled out because the JVM's class also holds the vertical tab.
GO_BOUNDARY = r"^func[\t\n\f\r ]+"
PYTHON_BOUNDARY = r"^(?:class|def)[\t\n\f\r ]+\w+"
SCRIPT_BOUNDARY = (
    r"^(?:export[\t\n\f\r ]+)?(?:async[\t\n\f\r ]+)?function[\t\n\f\r ]+\w+"
    r"|^class[\t\n\f\r ]+\w+"
)
JAVA_BOUNDARY = (
    r"^[\t\n\f\r ]*+(?:(?:public|private|protected)[\t\n\f\r ]*+)?(?:static[\t\n\f\r ]*+)?"
    r"\w++[\t\n\f\r ]++\w++[\t\n\f\r ]*+\("
)
HEADER_BOUNDARY = r"^#{1,6}[\t\n\f\r ]+"
YAML_KEY = r"^[a-zA-Z_][a-zA-Z0-9_-]*:"
JSON_KEY = r'\A\p{IsWhite_Space}*+"[^"]+"[\t\n\f\r ]*:'
TOML_SECTION = r"^[\t\n\f\r ]*\[[^\]]+\]"

_ESC = "\x01"
_MARK = "\x01\x03"
_FOLD_BLOCK = 256


def _chunk(content, start, end, kind, divisible: bool) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        content.alias("content"),
        start.cast("int").alias("start_line"),
        end.cast("int").alias("end_line"),
        kind.alias("chunk_type"),
        F.lit(divisible).alias("divisible"),
    )


def _no_chunks() -> Column:
    return F.array().cast(CHUNK_ARRAY)


def _line_numbers(lines: Column) -> Column:
    return F.sequence(F.lit(1), F.size(lines))


def _mark(content: Column, pattern: str) -> Column:
    """Insert a mark in front of every leftmost, non-overlapping match.

    The escape makes marks unambiguous whatever the text holds. Matches only
    start at line starts, so a marked line is one that begins with the mark.
    """
    escaped = F.replace(content, F.lit(_ESC), F.lit(_ESC + "\x02"))
    return F.regexp_replace(escaped, f"(?dm){pattern}", f"{_MARK}$0")


def _marked_lines(marked: Column) -> Column:
    return let(
        lines_of(marked),
        lambda ls: F.filter(_line_numbers(ls), lambda i: F.startswith(ls[i - 1], F.lit(_MARK))),
    )


def _last_line(lines: Column, first: Column, last: Column, dropped) -> Column:
    """Largest line number in ``first``..``last`` not ``dropped``, at least ``first``."""
    kept = F.filter(F.sequence(first, last), lambda i: ~dropped(lines[i - 1]))
    return F.greatest(first, F.coalesce(F.array_max(kept), first))


def _segment_end(bounds: Column, j: Column, lines: Column) -> Column:
    return F.coalesce(F.get(bounds, j + 1) - 1, F.size(lines))


def _trimmed_segments(lines: Column, bounds: Column, kind) -> Column:
    """Boundary to line before the next one, without trailing blank lines."""

    def segment(start: Column, j: Column) -> Column:
        return let(
            _last_line(lines, start, _segment_end(bounds, j, lines), is_blank),
            lambda end: let(
                join_lines(lines, start, end), lambda text: _chunk(text, start, end, kind(text), True)
            ),
        )

    return F.transform(bounds, segment)


def code_chunks(content: Column, language: Column) -> Column:
    """Function and class segments of source code, with an optional preamble."""
    marked = (
        F.when(language == "go", _mark(content, GO_BOUNDARY))
        .when(language == "python", _mark(content, PYTHON_BOUNDARY))
        .when(language.isin("javascript", "typescript"), _mark(content, SCRIPT_BOUNDARY))
        .when(language == "java", _mark(content, JAVA_BOUNDARY))
        .otherwise(F.replace(content, F.lit(_ESC), F.lit(_ESC + "\x02")))
    )

    def kind(text: Column) -> Column:
        class_language = language.isin("python", "javascript", "typescript")
        opens_class = F.rlike(text, F.lit(r"\A\p{IsWhite_Space}*+class "))
        return F.when(class_language & opens_class, "class").otherwise("function")

    def with_bounds(lines: Column, bounds: Column) -> Column:
        head = join_lines(lines, F.lit(1), bounds[0] - 1)
        preamble = F.when(
            (bounds[0] > 1) & ~is_blank(head),
            F.array(_chunk(head, F.lit(1), bounds[0] - 1, "preamble", False)),
        ).otherwise(_no_chunks())
        whole = F.array(_chunk(content, F.lit(1), F.size(lines), "code", False))
        return F.when(F.size(bounds) == 0, whole).otherwise(
            F.concat(preamble, _trimmed_segments(lines, bounds, kind))
        )

    body = let(
        lines_of(content),
        lambda lines: let(_marked_lines(marked), lambda bounds: with_bounds(lines, bounds)),
    )
    return F.when(is_blank(content), _no_chunks()).otherwise(body)


def markdown_chunks(content: Column) -> Column:
    """Header sections; text in front of the first header belongs to none."""

    def with_bounds(lines: Column, bounds: Column) -> Column:
        whole = F.array(_chunk(content, F.lit(1), F.size(lines), "paragraph", False))
        return F.when(F.size(bounds) == 0, whole).otherwise(
            _trimmed_segments(lines, bounds, lambda _text: F.lit("header"))
        )

    body = let(
        lines_of(content),
        lambda lines: let(
            _marked_lines(_mark(content, HEADER_BOUNDARY)),
            lambda bounds: with_bounds(lines, bounds),
        ),
    )
    return F.when(is_blank(content), _no_chunks()).otherwise(body)


def paragraph_chunks(content: Column) -> Column:
    """Maximal runs of lines that are not blank."""

    def runs(lines: Column, blank: Column) -> Column:
        n = F.size(lines)
        starts = F.filter(
            _line_numbers(lines),
            lambda i: ~blank[i - 1] & ((i == 1) | F.coalesce(F.get(blank, i - 2), F.lit(True))),
        )
        ends = F.filter(
            _line_numbers(lines),
            lambda i: ~blank[i - 1] & ((i == n) | F.coalesce(F.get(blank, i), F.lit(True))),
        )
        return let(
            ends,
            lambda last: F.transform(
                starts,
                lambda s, j: _chunk(join_lines(lines, s, last[j]), s, last[j], "paragraph", True),
            ),
        )

    return let(
        lines_of(content),
        lambda lines: let(F.transform(lines, is_blank), lambda blank: runs(lines, blank)),
    )


def yaml_chunks(content: Column) -> Column:
    """Top-level keys; only the last chunk's end line skips trailing blanks."""

    def segments(lines: Column, bounds: Column) -> Column:
        n = F.size(lines)

        def segment(start: Column, j: Column) -> Column:
            end = _segment_end(bounds, j, lines)
            final = F.get(bounds, j + 1).isNull()
            shown = F.when(final, _last_line(lines, start, n, is_blank)).otherwise(end)
            return _chunk(join_lines(lines, start, end), start, shown, "config_key", True)

        return F.transform(bounds, segment)

    return let(
        lines_of(content),
        lambda lines: let(
            F.filter(_line_numbers(lines), lambda i: F.rlike(lines[i - 1], F.lit(YAML_KEY))),
            lambda bounds: segments(lines, bounds),
        ),
    )


def toml_chunks(content: Column) -> Column:
    """Sections; lines before the first one form a chunk without its blanks."""

    def preamble(lines: Column, bounds: Column) -> Column:
        last = F.coalesce(F.get(bounds, F.lit(0)) - 1, F.size(lines))
        numbers = F.when(last < 1, F.array().cast("array<int>")).otherwise(
            F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: ~is_blank(lines[i - 1]))
        )
        return let(
            numbers,
            lambda kept: F.when(F.size(kept) == 0, _no_chunks()).otherwise(
                F.array(
                    _chunk(
                        F.array_join(F.transform(kept, lambda i: lines[i - 1]), "\n"),
                        kept[0],
                        F.element_at(kept, -1),
                        "config_key",
                        True,
                    )
                )
            ),
        )

    def segments(lines: Column, bounds: Column) -> Column:
        def segment(start: Column, j: Column) -> Column:
            end = _segment_end(bounds, j, lines)
            shown = _last_line(lines, start, end, is_blank)
            return _chunk(join_lines(lines, start, end), start, shown, "config_key", True)

        return F.concat(preamble(lines, bounds), F.transform(bounds, segment))

    return let(
        lines_of(content),
        lambda lines: let(
            F.filter(_line_numbers(lines), lambda i: F.rlike(lines[i - 1], F.lit(TOML_SECTION))),
            lambda bounds: segments(lines, bounds),
        ),
    )


def _net(line: Column, opening: str, closing: str) -> Column:
    def count(c: str) -> Column:
        return F.length(line) - F.length(F.replace(line, F.lit(c), F.lit("")))

    return count(opening) - count(closing)


def _json_key_lines(lines: Column) -> Column:
    """Lines that hold a key while one brace and no bracket is open.

    The depth after each line is a running sum. Summing line by line while
    appending to one array would copy that array for every key, so the fold is
    done in two levels: depth at the start of each block of lines first, then
    inside the blocks, whose results are short.
    """
    n = F.size(lines)
    depth_type = "struct<brace:int,bracket:int>"

    def advance(depth: Column, line: Column) -> Column:
        changed = F.struct(
            (depth.brace + _net(line, "{", "}")).cast("int").alias("brace"),
            (depth.bracket + _net(line, "[", "]")).cast("int").alias("bracket"),
        )
        return F.when(F.rlike(line, F.lit(r"[{}\[\]]")), changed).otherwise(depth)

    zero = F.struct(F.lit(0).alias("brace"), F.lit(0).alias("bracket")).cast(depth_type)
    block_starts = F.sequence(F.lit(1), n, F.lit(_FOLD_BLOCK))

    def block_total(first: Column) -> Column:
        return F.aggregate(F.slice(lines, first, F.lit(_FOLD_BLOCK)), zero, advance)

    def depths_before(totals: Column) -> Column:
        def push(acc: Column, total: Column) -> Column:
            last = F.element_at(acc, -1)
            nxt = F.struct(
                (last.brace + total.brace).alias("brace"),
                (last.bracket + total.bracket).alias("bracket"),
            )
            return F.concat(acc, F.array(nxt))

        return F.aggregate(totals, F.array(zero).cast(f"array<{depth_type}>"), push)

    state_type = f"struct<depth:{depth_type},number:int,keys:array<int>>"

    def keys_in_block(first: Column, depth: Column) -> Column:
        start = F.struct(
            depth.alias("depth"),
            first.cast("int").alias("number"),
            F.array().cast("array<int>").alias("keys"),
        ).cast(state_type)

        def step(state: Column, line: Column) -> Column:
            return let(
                advance(state.depth, line),
                lambda after: F.struct(
                    after.alias("depth"),
                    (state.number + 1).alias("number"),
                    F.when(
                        (after.brace == 1)
                        & (after.bracket == 0)
                        & F.rlike(line, F.lit(JSON_KEY)),
                        F.concat(state["keys"], F.array(state.number)),
                    )
                    .otherwise(state["keys"])
                    .alias("keys"),
                ).cast(state_type),
            )

        return F.aggregate(
            F.slice(lines, first, F.lit(_FOLD_BLOCK)), start, step, lambda s: s["keys"]
        )

    return let(
        depths_before(F.transform(block_starts, block_total)),
        lambda depths: F.flatten(
            F.transform(block_starts, lambda first, b: keys_in_block(first, depths[b]))
        ),
    )


def json_chunks(content: Column) -> Column:
    """Line-based split at the keys of the outermost object."""

    def closes(line: Column) -> Column:
        return F.rlike(line, F.lit(r"\A\p{IsWhite_Space}*+(?:\},?)?\p{IsWhite_Space}*+\z"))

    def lone_brace(line: Column) -> Column:
        return F.rlike(line, F.lit(r"\A\p{IsWhite_Space}*+[{}]\p{IsWhite_Space}*+\z"))

    def segments(lines: Column, bounds: Column) -> Column:
        def segment(start: Column, j: Column) -> Column:
            end = _segment_end(bounds, j, lines)
            final = F.get(bounds, j + 1).isNull()
            shown = F.when(final, _last_line(lines, start, end, closes)).otherwise(end)
            rest = F.filter(F.slice(lines, start + 1, end - start), lambda l: ~lone_brace(l))
            text = trim_space(F.array_join(F.concat(F.array(lines[start - 1]), rest), "\n"))
            return _chunk(F.regexp_replace(text, r",\z", ""), start, shown, "config_key", True)

        return F.transform(bounds, segment)

    return let(
        lines_of(content),
        lambda lines: let(_json_key_lines(lines), lambda bounds: segments(lines, bounds)),
    )


def chunks_for_route(content: Column, route: Column) -> Column:
    """Dispatch by route; every route without a chunker of its own is prose."""
    return (
        F.when(
            route.isin("go", "python", "javascript", "typescript", "java"),
            code_chunks(content, route),
        )
        .when(route == "markdown", markdown_chunks(content))
        .when(route == "yaml", yaml_chunks(content))
        .when(route == "json", json_chunks(content))
        .when(route == "toml", toml_chunks(content))
        .otherwise(paragraph_chunks(content))
    )


def pieces(content: Column, start: Column, end: Column, limit: int) -> Column:
    """Greedy packing of a chunk's lines into pieces of at most ``limit`` bytes.

    One pass over the lines carries the bytes in the current piece and appends a
    line number only where a new piece opens. A later piece begins with the
    newline that separated it; a single line over the limit stays whole.
    """
    state_type = "struct<number:int,used:int,opens:array<int>>"
    zero = F.struct(
        F.lit(0).alias("number"), F.lit(0).alias("used"), F.array(F.lit(0)).alias("opens")
    ).cast(state_type)

    def step(state: Column, line: Column) -> Column:
        size = F.octet_length(line)
        opens = (state.used + size + 1 > limit) & (state.used > 0)
        joint = F.when(state.number > 0, 1).otherwise(0)
        return F.struct(
            (state.number + 1).alias("number"),
            (F.when(opens, 0).otherwise(state.used) + joint + size).alias("used"),
            F.when(opens, F.concat(state.opens, F.array(state.number)))
            .otherwise(state.opens)
            .alias("opens"),
        ).cast(state_type)

    def cut(lines: Column, opens: Column) -> Column:
        def piece(first: Column, p: Column) -> Column:
            following = F.get(opens, p + 1)
            last = F.coalesce(following, F.size(lines))
            text = join_lines(lines, first + 1, last)
            return F.struct(
                F.when(p > 0, F.concat(F.lit("\n"), text)).otherwise(text).alias("content"),
                (start + first).cast("int").alias("start_line"),
                F.coalesce(start + following - 1, end).cast("int").alias("end_line"),
            )

        return F.transform(opens, piece)

    return let(
        lines_of(content),
        lambda lines: let(
            F.aggregate(lines, zero, step, lambda s: s.opens), lambda opens: cut(lines, opens)
        ),
    )
