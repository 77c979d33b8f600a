"""The expected results in SQL, for DuckDB, over the same tables.

RE2 has no look-around, so candidates are matched together with the character
ahead of them and that character is taken off again.  The statements are an
independent statement of the semantics, not a copy of the Spark expressions:
offsets come from the gaps between matches, contexts from substrings.
"""

from __future__ import annotations

from workload import fixtures

URL = r"""https?://[^\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}<>"{}|\\^`\[\]]+"""
SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
RUN = rf"(?:^|[^0-9])(\d[\d\-{SPACE}]{{8,16}}[\dXx])\b"
SEPARATOR = rf"[-{SPACE}]"
TRIM = rf"^[{SPACE}]+|[{SPACE}]+$"

ARTICLES = f"articles as ({fixtures.ARTICLES})"


def checks(expression: str) -> dict[str, str]:
    """ISBN-10 and ISBN-13 checks of a cleaned, upper-cased expression."""
    digit = [f"cast(substr({expression}, {i}, 1) as integer)" for i in range(1, 14)]
    ten = " + ".join(f"{11 - i} * {digit[i - 1]}" for i in range(1, 10))
    last = f"case when right({expression}, 1) = 'X' then 10 else {digit[9]} end"
    thirteen = " + ".join(f"{1 if i % 2 else 3} * {digit[i - 1]}" for i in range(1, 14))
    return {
        "isbn10": f"case when regexp_full_match({expression}, '[0-9]{{9}}[0-9X]') then ({ten} + {last}) % 11 = 0 else false end",
        "isbn13": f"case when regexp_full_match({expression}, '[0-9]{{13}}') then ({thirteen}) % 10 = 0 else false end",
    }


_CHECK = checks("normalized")
VALID = f"case length(normalized) when 10 then {_CHECK['isbn10']} when 13 then {_CHECK['isbn13']} else false end"
FORMAT = "case length(normalized) when 10 then 'ISBN-10' when 13 then 'ISBN-13' else concat('Invalid (', length(normalized), ' digits)') end"

def candidates(context: int = 50, proximity: int = 6) -> str:
    """CTEs up to ``candidates``: numbers of ISBN shape with what surrounds them."""
    look = proximity + 4
    return rf"""{ARTICLES},
clean as (select page_id, title, language, regexp_replace(text, '{URL}', ' ', 'g') as t from articles),
matched as (
  select *, regexp_extract_all(t, '{RUN}', 1) as runs, regexp_extract_all(t, '{RUN}', 0) as whole,
         string_split_regex(t, '{RUN}') as gaps
  from clean),
placed as (
  select page_id, title, language, t, unnest(runs) as isbn,
         unnest(list_transform(range(1, len(runs) + 1), lambda i:
           cast(list_sum(list_transform(gaps[1:i], lambda g: length(g))) as bigint)
           + coalesce(cast(list_sum(list_transform(whole[1:i-1], lambda w: length(w))) as bigint), 0)
           + length(whole[i]) - length(runs[i]))) as start
  from matched),
candidates as (
  select *, upper(regexp_replace(isbn, '{SEPARATOR}', '', 'g')) as normalized,
         substr(t, greatest(start - {look}, 0) + 1, least(start, {look})) as before,
         regexp_replace(substr(t, greatest(start - {context}, 0) + 1, least(start, {context}) + length(isbn) + {context}), '{TRIM}', '', 'g') as context
  from placed
  where regexp_full_match(upper(regexp_replace(isbn, '{SEPARATOR}', '', 'g')), '[0-9]{{9}}[0-9X]|[0-9]{{13}}'))"""

def hits(context: int = 50, proximity: int = 6) -> str:
    """CTEs up to ``hits``: the candidates with the keyword in reach."""
    return rf"""{candidates(context, proximity)},
hits as (
  select page_id, language, title,
         concat('https://', language, '.wikipedia.org/wiki/', replace(title, ' ', '_')) as url,
         cast(row_number() over (partition by page_id order by start) - 1 as integer) as k,
         isbn, normalized, {FORMAT} as format, context, cast(start as integer) as start, {VALID} as is_valid,
         regexp_replace(isbn, '{SEPARATOR}', '', 'g') as unique_form
  from candidates where regexp_matches(lower(before), '(?s)isbn.{{0,{proximity}}}$'))"""

CANDIDATES = candidates()
HITS = hits()

RATE = "coalesce(count(*) filter (where is_valid) / nullif(count(*), 0) * 100, 0)"

TOTALS = f"""select (select count(*) from articles) as articles_processed,
  count(distinct page_id) as articles_with_isbn,
  (select count(*) from articles) - count(distinct page_id) as articles_without_isbn,
  count(*) as total, count(*) filter (where is_valid) as valid, count(*) filter (where not is_valid) as invalid,
  {RATE} as pass_rate,
  count(distinct unique_form) filter (where is_valid) as unique_valid,
  count(distinct unique_form) filter (where not is_valid) as unique_invalid,
  count(*) filter (where is_valid and format = 'ISBN-10') as isbn10_valid,
  count(*) filter (where not is_valid and format = 'ISBN-10') as isbn10_invalid,
  count(*) filter (where is_valid and format = 'ISBN-13') as isbn13_valid,
  count(*) filter (where not is_valid and format = 'ISBN-13') as isbn13_invalid
  from hits"""

LANGUAGES = f"""languages as (
  select language, max(n) as articles_processed, count(distinct page_id) as articles_with_isbn,
    count(*) as total, count(*) filter (where is_valid) as valid, count(*) filter (where not is_valid) as invalid,
    {RATE} as pass_rate,
    count(distinct unique_form) filter (where is_valid) as unique_valid,
    count(distinct unique_form) filter (where not is_valid) as unique_invalid
  from hits join (select language, count(*) as n from articles group by language) using (language)
  group by language)"""
