"""Finding ISBN candidates inside text.

One pass of one regular expression returns, for every candidate, a *window*:
the characters before it, the candidate, the characters after it.  Proximity,
shape and context are then read off the window, so the work per article is
linear in its length however many numbers it holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colophon.functions import patterns as p
from colophon.functions.binding import let
from colophon.functions.checksum import is_isbn_shaped
from colophon.functions.text import as_column, ColumnLike, strip_urls, trim_space

# Java measures look-behind in UTF-16 units unless the pattern itself holds a
# character beyond the BMP; with one it counts whole characters, as we must.
_ANY_CHARACTER = "[\\s\\S\U00010000]"

SHORTEST_RUN, LONGEST_RUN = 10, 18


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda acc, x: acc + x)


def running_total(values: Column, block: int = 128) -> Column:
    """Inclusive running total of an int array, summed block by block.

    Blocks keep the cost near ``n * block`` where one flat pass over all
    prefixes would be quadratic.
    """

    def totals_of(blocks: Column) -> Column:
        before = let(
            F.transform(blocks, _total),
            lambda sums: F.transform(sums, lambda _, b: _total(F.slice(sums, F.lit(1), b))),
        )
        return F.flatten(
            F.zip_with(
                blocks,
                before,
                lambda chunk, base: F.transform(
                    chunk, lambda _, i: base + _total(F.slice(chunk, F.lit(1), i + 1))
                ),
            )
        )

    def in_blocks(bound: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(bound), F.lit(block))
        return let(F.transform(firsts, lambda at: F.slice(bound, at, F.lit(block))), totals_of)

    return let(values, in_blocks)


def candidate_values(text: ColumnLike) -> Column:
    """All digit runs of URL-free text, left to right, not overlapping."""
    return F.regexp_extract_all(as_column(text), F.lit(p.CANDIDATE), F.lit(1))


def candidate_starts(text: ColumnLike) -> Column:
    """Zero-based character offset of each of ``candidate_values(text)``."""
    text = as_column(text)
    gaps = F.split(text, p.CANDIDATE, -1)
    previous = F.concat(F.array(F.lit("")), candidate_values(text))
    steps = F.zip_with(gaps, previous, lambda gap, run: F.length(gap) + F.length(run))
    # The last step leads to the end of the text, not to a candidate.
    return let(running_total(steps), lambda s: F.slice(s, F.lit(1), F.size(s) - 1))


def _window_pattern(before: int, after: int, lead: str = "") -> str:
    run = p.RUN + p.NOT_BEFORE_WORD
    window = f"[\\s\\S]{{{before}}}{run}[\\s\\S]{{0,{after}}}"
    # The capture sits in a look-ahead that starts `before` characters back, so
    # windows may overlap while the candidates themselves do not.
    back = f"(?<=(?=({window})){_ANY_CHARACTER}{{{before}}})"
    return f"(?U){lead}(?=\\d){p.NOT_AFTER_DIGIT}{back}{run}"


def _keyword_lead(proximity: int) -> str:
    """Keyword and gap ahead of a candidate, where that is all that can match.

    A run never crosses the keyword.  With a gap shorter than any run, the only
    run that can start within reach of a keyword is the first one after it, so
    the pattern may go from keyword to keyword instead of from digit to digit.
    With a longer reach every run has to be looked at.
    """
    if proximity >= SHORTEST_RUN:
        return ""
    key = p.KEYWORD_ANY_CASE
    return f"{key}(?:(?!{key})[\\s\\S]){{0,{proximity}}}?"


def has_isbn_nearby(before: ColumnLike, proximity: int = p.DEFAULT_PROXIMITY) -> Column:
    """True when ``isbn`` ends at most ``proximity`` characters before the number.

    ``before`` is what precedes the number.  It is cut to the window first and
    lower-cased after, so letters that grow in lower case count as they do then.
    """
    return _ends_near(F.right(as_column(before), F.lit(proximity + len(p.KEYWORD))), proximity)


def _ends_near(window: Column, proximity: int) -> Column:
    # Reversed, the last occurrence comes first and its position is the distance.
    at = F.instr(F.reverse(F.lower(window)), p.KEYWORD[::-1])
    return at.isin(list(range(1, proximity + 2)))


def may_hold_isbn(text: ColumnLike) -> Column:
    """Cheap test that is true for every text with a hit.

    Lower-casing a text costs a copy of it; most texts are settled before that
    by looking for two letters of the keyword as they stand.
    """
    text = as_column(text)
    pair = text.contains("SB") | text.contains("sb") | text.contains("Sb") | text.contains("sB")
    return pair & F.lower(text).contains(p.KEYWORD)


class Windows:
    """The windows of a text, one per candidate: ``ARRAY<STRING>``.

    Each has ``head`` characters ahead of the candidate, the text being padded
    with blanks at its start, and up to ``tail`` characters after it.  With
    ``proximity`` only candidates near the keyword are kept.
    """

    def __init__(self, context_chars: int, proximity: int | None = None) -> None:
        self.context_chars = context_chars
        self.proximity = proximity
        self.lookback = 0 if proximity is None else proximity + len(p.KEYWORD)
        self.head = max(context_chars, self.lookback)
        # Enough to see past the longest run, so that it is cut alike in the window.
        self.tail = max(context_chars, LONGEST_RUN - SHORTEST_RUN + 1)

    def of(self, clean: Column) -> Column:
        """Windows of URL-free text that hold a hit."""
        lead = "" if self.proximity is None else _keyword_lead(self.proximity)
        return F.filter(self._matches(clean, lead), self.is_hit)

    def with_starts(self, clean: Column) -> Column:
        """``ARRAY<STRUCT<window, start>>``; needs every candidate to count from."""
        every = F.zip_with(
            self._matches(clean, ""),
            candidate_starts(clean),
            lambda w, s: F.struct(w.alias("window"), s.alias("start")),
        )
        return F.filter(every, lambda c: self.is_hit(c["window"]))

    def _matches(self, clean: Column, lead: str) -> Column:
        padded = F.concat(F.lit(" " * self.head), clean)
        pattern = _window_pattern(self.head, self.tail, lead)
        return F.regexp_extract_all(padded, F.lit(pattern), F.lit(1))

    def is_hit(self, window: Column) -> Column:
        shaped = is_isbn_shaped(self.isbn(window))
        if self.proximity is None:
            return shaped
        before = F.substring(window, self.head - self.lookback + 1, self.lookback)
        return _ends_near(before, self.proximity) & shaped

    def isbn(self, window: Column) -> Column:
        ahead = F.substring(window, self.head + 1, LONGEST_RUN + 1)
        return F.regexp_extract(ahead, rf"(?U)\A({p.RUN}){p.NOT_BEFORE_WORD}", 1)

    def context(self, window: Column) -> Column:
        """What stands around the candidate, trimmed; padding goes with the blanks."""
        start = F.lit(self.head - self.context_chars + 1)
        if self.tail == self.context_chars:
            return trim_space(F.substr(window, start))
        length = F.length(self.isbn(window)) + 2 * self.context_chars
        return trim_space(F.substr(window, start, length))

    def fields(self, hit: Column, offsets: bool) -> list[Column]:
        """``isbn``, ``context`` and perhaps ``start`` of an element of the arrays above."""
        window = hit["window"] if offsets else hit
        fields = [self.isbn(window).alias("isbn"), self.context(window).alias("context")]
        return [*fields, hit["start"].alias("start")] if offsets else fields


def hit_windows(text: ColumnLike, windows: Windows, offsets: bool = False) -> Column:
    """Windows of the hits in raw text.

    URLs are removed first.  Texts without the keyword give NULL without any
    pattern being run over them.
    """
    clean = strip_urls(text)
    found = let(clean, windows.with_starts) if offsets else windows.of(clean)
    return F.when(may_hold_isbn(text), found)


def find_potential_isbns(
    text: ColumnLike,
    context_chars: int = p.DEFAULT_CONTEXT,
    proximity: int = p.DEFAULT_PROXIMITY,
    offsets: bool = False,
) -> Column:
    """``ARRAY<STRUCT<isbn, context[, start]>>`` of the ISBNs in raw text; NULL when it
    does not hold the keyword.
    """
    windows = Windows(context_chars, proximity)
    return F.transform(
        hit_windows(text, windows, offsets), lambda h: F.struct(*windows.fields(h, offsets))
    )
