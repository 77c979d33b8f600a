"""The driver's queries: each a Spark job over the given tables, with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colophon import functions as C
from colophon.operators import hits as H
from colophon.operators import listing as L
from colophon.operators import stats as S
from colophon.operators import structure as X
from colophon.plans.audit import run_audit
from colophon.plans.failures import analyze_invalid_isbns
from colophon.plans.fetch_list import fetch_list
from colophon.plans.ledger import Ledger
from colophon.sources import dumps as D
from colophon.sources.failed_csv import read_failed_csv, write_failed_csv
from colophon.sources.inventory import read_heads, read_inventory, with_codes
from colophon.sources.reports import pass_rates, read_reports, write_report
from colophon.streaming.incremental import append_new_hits, follow_dumps, read_article_counts, update_article_counts
from colophon.workspace import new_folder, spread
from workload import oracle as O
from workload import fixtures as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(expected: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        QUERIES[run.__name__] = run
        if expected is not None:
            ORACLES[run.__name__] = expected
        return run

    return add


# -- filters and projections -------------------------------------------------


@query(
    f"""select page_id, title, ns, length(text) as n_chars from ({W.PAGE_KINDS}) p
    where ns = '0' and not redirect and title <> '' and text <> ''"""
)
def article_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = W.sql(spark, sf_dir, W.PAGE_KINDS, "orders", "documents")
    return pages.filter(D.is_article()).select("page_id", "title", "ns", F.length("text").alias("n_chars"))


FILE_NAMES = """
select c_custkey,
 concat(case c_custkey % 6 when 0 then 'zh-yue' when 1 then 'zh_yue' when 2 then upper(code) when 3 then '' else code end,
        case c_custkey % 5 when 0 then 'wiktionary-' else 'wiki-' end, '2025', lpad(cast(c_nationkey as varchar(20)), 4, '0'),
        '-pages-articles-multistream.xml.bz2') as file_name
from (select c_custkey, c_nationkey, translate(cast(c_custkey as varchar(20)), '0123456789', 'abcdefghij') as code from customer) q
"""


@query(
    rf"""select file_name,
    case when regexp_matches(file_name, '^[a-z]+wiki-') then regexp_extract(file_name, '^([a-z]+)wiki-', 1) else 'en' end as language
    from ({FILE_NAMES}) f"""
)
def dump_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = W.sql(spark, sf_dir, FILE_NAMES, "customer")
    return names.select("file_name", C.dump_language("file_name").alias("language"))


@query(
    rf"""select file_name, regexp_extract(file_name, '^([a-z\-]+)wiki-', 1) as language,
    nullif(regexp_extract(file_name, 'wiki-(\d{{8}})-', 1), '') as dump_date
    from ({FILE_NAMES}) f where regexp_matches(file_name, '^[a-z\-]+wiki-')"""
)
def inventory_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = W.sql(spark, sf_dir, FILE_NAMES, "customer")
    return with_codes(names).select("file_name", "language", "dump_date")


@query(
    f"""select page_id, concat('https://', language, '.wikipedia.org/wiki/', replace(title, ' ', '_')) as url,
    upper(language) as label from ({W.ARTICLES}) a"""
)
def article_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = W.articles(spark, sf_dir)
    return a.select(
        "page_id",
        C.article_url("language", "title").alias("url"),
        C.language_label("language").alias("label"),
    )


# -- scalar functions --------------------------------------------------------


@query(f"with {O.ARTICLES} select page_id, regexp_replace(text, '{O.URL}', ' ', 'g') as clean from articles")
def strip_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.articles(spark, sf_dir).select("page_id", C.strip_urls("text").alias("clean"))


@query(f"with {O.CANDIDATES} select page_id, isbn, cast(start as integer) as start from candidates")
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.find_candidates(W.articles(spark, sf_dir)).select("page_id", "isbn", "start")


KEYWORD_GAPS = """
select o_orderkey,
 concat('x ', case o_orderkey % 4 when 0 then 'ISBN' when 1 then 'eIsbn' when 2 then 'isbn' else 'OCLC' end,
        repeat(' ', cast(o_orderkey % 12 as int)), case when o_custkey % 9 = 0 then 'ISBN:' else '' end) as before
from orders
"""


@query(
    f"""select o_orderkey, regexp_matches(lower(right(before, 10)), '(?s)isbn.{{0,6}}$') as near,
    regexp_matches(lower(right(before, 14)), '(?s)isbn.{{0,10}}$') as near_10 from ({KEYWORD_GAPS}) g"""
)
def proximity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = W.sql(spark, sf_dir, KEYWORD_GAPS, "orders")
    return gaps.select(
        "o_orderkey",
        C.has_isbn_nearby("before").alias("near"),
        C.has_isbn_nearby("before", 10).alias("near_10"),
    )


@query(f"with {O.hits(20)} select page_id, k, context from hits")
def isbn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = H.find_isbns(W.articles(spark, sf_dir), context=20)
    return hits.select("page_id", "k", "context")


# Spellings of one number: hyphens, blanks, small x, cut short, with a letter.
SPELLINGS = """
select l_orderkey, l_linenumber,
 case (l_orderkey + l_linenumber) % 6
  when 0 then concat(substr(b,1,1), '-', substr(b,2,3), '-', substr(b,5,5), '-', c)
  when 1 then concat(' ', b, ' ', lower(c), ' ')
  when 2 then concat('978-', b, d)
  when 3 then concat('979 ', substr(b,1,4), ' ', substr(b,5,5), d)
  when 4 then concat(substr(b, 1, cast(l_linenumber as int)), c)
  else concat(b, case when l_linenumber = 1 then 'Y' else c end, case when l_linenumber = 2 then '000' else '' end)
 end as isbn
from (select l_orderkey, l_linenumber,
             lpad(cast((l_partkey * 7919 + l_suppkey * 31 + l_orderkey) % 1000000000 as varchar(20)), 9, '0') as b,
             case when l_orderkey % 11 = 10 then 'X' else cast(l_orderkey % 11 as varchar(20)) end as c,
             cast(l_partkey % 10 as varchar(20)) as d
      from lineitem) q
"""
CLEANED = rf"""(select *, regexp_replace(isbn, '{O.SEPARATOR}', '', 'g') as stripped,
 upper(regexp_replace(isbn, '{O.SEPARATOR}', '', 'g')) as normalized from ({SPELLINGS}) s)"""


def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(W.sql(spark, sf_dir, SPELLINGS, "lineitem"), W.parts(spark), "l_orderkey", "l_linenumber")


@query(f"select l_orderkey, l_linenumber, normalized, stripped from {CLEANED} c")
def normalize_isbn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(spark, sf_dir).select(
        "l_orderkey",
        "l_linenumber",
        C.normalize_isbn("isbn").alias("normalized"),
        C.strip_separators("isbn").alias("stripped"),
    )


@query(f"select l_orderkey, l_linenumber, {O.checks('normalized')['isbn10']} as is_valid from {CLEANED} c")
def isbn10_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", C.validate_isbn10("isbn").alias("is_valid")
    )


@query(f"select l_orderkey, l_linenumber, {O.checks('normalized')['isbn13']} as is_valid from {CLEANED} c")
def isbn13_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spellings(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", C.validate_isbn13("isbn").alias("is_valid")
    )


@query(
    f"""select l_orderkey, l_linenumber, {O.VALID} as is_valid, {O.FORMAT} as format,
    regexp_full_match(normalized, '[0-9]{{9}}[0-9X]|[0-9]{{13}}') as shaped from {CLEANED} c"""
)
def isbn_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = H.with_checks(spellings(spark, sf_dir))
    return checked.select(
        "l_orderkey", "l_linenumber", "is_valid", "format", C.is_isbn_shaped("isbn").alias("shaped")
    )


@query(
    f"""select l_orderkey, l_linenumber, {O.VALID} as is_valid, {O.FORMAT} as format from {CLEANED} c
    where regexp_full_match(normalized, '[0-9]{{9}}[0-9X]|[0-9]{{13}}')"""
)
def isbn_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same checks as plain Column functions."""
    return spellings(spark, sf_dir).filter(C.is_isbn_shaped("isbn")).select(
        "l_orderkey",
        "l_linenumber",
        C.validate_isbn("isbn").alias("is_valid"),
        C.isbn_format("isbn").alias("format"),
    )


@query(
    """select o_orderkey, printf('%.2f', o_totalprice / 7) as two, printf('%.1f', o_totalprice / 7) as one,
    format('{:,}', o_orderkey * 1000 + o_custkey) as grouped from orders"""
)
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.register(spark, sf_dir, "orders")
    price = F.col("o_totalprice") / 7
    return spark.table("orders").select(
        "o_orderkey",
        C.fixed(price, 2).alias("two"),
        C.fixed(price, 1).alias("one"),
        C.thousands(F.col("o_orderkey") * 1000 + F.col("o_custkey")).alias("grouped"),
    )


# -- hits ---------------------------------------------------------------------

HIT_LIST = "page_id, language, title, url, k, isbn, normalized, format, context, start, is_valid"


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.articles(spark, sf_dir).withColumn("url", C.article_url("language", "title"))


@query(f"with {O.HITS} select {HIT_LIST} from hits")
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.find_isbns(linked(spark, sf_dir), offsets=True).select(*HIT_LIST.split(", "))


@query(f"with {O.hits(75, 10)} select page_id, k, isbn, context, is_valid from hits")
def hits_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.find_isbns(W.articles(spark, sf_dir), context=75, proximity=10)
    return found.select("page_id", "k", "isbn", "context", "is_valid")


@query(f"with {O.hits(0, 25)} select page_id, k, isbn, context, start, is_valid from hits")
def hits_far(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = H.find_isbns(W.articles(spark, sf_dir), context=0, proximity=25, offsets=True)
    return found.select("page_id", "k", "isbn", "context", "start", "is_valid")


@query(
    f"""with {O.HITS} select page_id, language, title, url, count(*) as total_found,
    coalesce(string_agg(concat(isbn, '~', context), '|' order by k) filter (where is_valid), '') as valid_isbns,
    coalesce(string_agg(concat(isbn, '~', context), '|' order by k) filter (where not is_valid), '') as invalid_isbns
    from hits group by page_id, language, title, url"""
)
def article_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(name: str) -> F.Column:
        parts = F.transform(name, lambda h: F.concat(h["isbn"], F.lit("~"), h["context"]))
        return F.array_join(parts, "|").alias(name)

    results = H.article_results(linked(spark, sf_dir))
    return results.select(
        "page_id",
        "language",
        "title",
        "url",
        F.col("total_found").cast("long").alias("total_found"),
        joined("valid_isbns"),
        joined("invalid_isbns"),
    )


FAILED = f"""{O.HITS}, failed as (select page_id, k, title as article_title, language, isbn, format, context,
 url as article_url from hits where not is_valid)"""
FAILED_LIST = "article_title, language, isbn, format, context, article_url"


def failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.failed_isbns(H.find_isbns(linked(spark, sf_dir)), "page_id", "k")


@query(f"with {FAILED} select {FAILED_LIST} from failed")
def failed_isbns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return failed(spark, sf_dir).drop("page_id", "k")


@query(f"with {FAILED} select {FAILED_LIST} from failed")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_failed_csv(
        failed(spark, sf_dir), new_folder(spark, "failed"), ("page_id", "k"), rows_per_file=10_000
    )
    return read_failed_csv(spark, path).drop("file", "row_id")


@query(
    f"""with {O.HITS} select normalized, arg_min(isbn, page_id * 1000000 + k) as isbn,
    min(page_id * 1000000 + k) as at from hits group by normalized"""
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = H.deduplicate_isbns(H.find_isbns(W.articles(spark, sf_dir)), ("page_id", "k"))
    return first.select("normalized", "isbn", (F.col("page_id") * 1000000 + F.col("k")).alias("at"))


# -- statistics ----------------------------------------------------------------


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rollup_articles(H.scan_articles(W.articles(spark, sf_dir)))


@query(f"with {O.HITS} {O.TOTALS}")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.totals(rollup(spark, sf_dir))


@query(
    f"""with {O.HITS} select count(distinct unique_form) filter (where is_valid) as unique_valid,
    count(distinct unique_form) filter (where not is_valid) as unique_invalid from hits"""
)
def unique_isbns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.unique_isbns(S.rollup_hits(H.find_isbns(W.articles(spark, sf_dir))))


@query(
    f"""with {O.HITS} select f.format, count(h.isbn) filter (where is_valid) as valid,
    count(h.isbn) filter (where not is_valid) as invalid
    from (values ('ISBN-10'), ('ISBN-13')) f(format) left join hits h on h.format = f.format group by f.format"""
)
def format_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.format_breakdown(rollup(spark, sf_dir))


@query(f"with {O.HITS}, {O.LANGUAGES} select * from languages")
def language_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.language_breakdown(rollup(spark, sf_dir))


@query(f"with {O.HITS}, {O.LANGUAGES} select * from languages")
def language_breakdown_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = W.articles(spark, sf_dir)
    breakdown = S.language_breakdown(S.rollup_hits(H.find_isbns(a)))
    return S.attach_article_counts(breakdown, S.articles_processed(a))


@query(f"select language, count(*) as articles_processed from ({W.ARTICLES}) a group by language")
def articles_per_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.articles_processed(W.articles(spark, sf_dir))


FAILURE_COUNTS = f"""with {FAILED}
select 'total' as dimension, null as value, count(*) as failed from failed
union all select 'format', format, count(*) from failed group by format
union all select 'language', language, count(*) from failed group by language"""


@query(FAILURE_COUNTS)
def failure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.failure_counts(failed(spark, sf_dir))


TOP = f"""with {FAILED} select article_title, count(*) as failed from failed group by article_title
order by failed desc, min(page_id * 1000000 + k) limit 10"""


@query(TOP)
def top_failing_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.top_failing_articles(failed(spark, sf_dir), ("page_id", "k"))


@query(TOP)
def top_articles_of_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_failed_csv(failed(spark, sf_dir), new_folder(spark, "failed"), ("page_id", "k"))
    return analyze_invalid_isbns(spark, path).top_articles


@query(FAILURE_COUNTS)
def counts_of_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = write_failed_csv(failed(spark, sf_dir), new_folder(spark, "failed"))
    return analyze_invalid_isbns(spark, path).counts


@query(
    rf"""with {O.HITS}, t as ({O.TOTALS}) select case when total = 0 then 'No ISBNs found' else
    concat(chr(10), 'ISBN Validation Summary', chr(10), '=======================', chr(10),
    'Total ISBNs found: ', format('{{:,}}', total), chr(10),
    'Valid ISBNs: ', format('{{:,}}', valid), ' (', printf('%.2f', pass_rate), '%)', chr(10),
    'Invalid ISBNs: ', format('{{:,}}', invalid), ' (', printf('%.2f', 100 - pass_rate), '%)', chr(10), chr(10),
    'Unique ISBNs:', chr(10), '- Valid: ', format('{{:,}}', unique_valid), chr(10),
    '- Invalid: ', format('{{:,}}', unique_invalid), chr(10), chr(10),
    'Articles processed: ', format('{{:,}}', articles_with_isbn), chr(10)) end as summary from t"""
)
def statistics_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.statistics_summary(rollup(spark, sf_dir))


# -- reports -------------------------------------------------------------------

REPORT_TEXTS = """
select c_custkey,
 concat('Some report', chr(10), 'XX:', chr(10), 'Pass rate: 1.00%', chr(10),
  case when c_custkey % 10 = 0 then 'No breakdown' else 'Language Breakdown:' end, chr(10), chr(10),
  '  ', code, ':', chr(10), '    Total ISBNs: ', cast(c_nationkey as varchar(20)), chr(10),
  '    Pass rate: ', cast(c_custkey % 100 as varchar(20)), '.', lpad(cast(c_nationkey as varchar(20)), 2, '0'), '%', chr(10), chr(10),
  '  ZH-', code, ':', chr(10), '    Pass rate: ', cast(c_nationkey as varchar(20)), '.5%', chr(10)) as content
from (select c_custkey, c_nationkey, translate(cast(c_custkey as varchar(20)), '0123456789', 'ABCDEFGHIJ') as code from customer) q
"""


@query(
    rf"""with sections as (select c_custkey, substr(content, strpos(content, 'Language Breakdown:')) as s
      from ({REPORT_TEXTS}) r where contains(content, 'Language Breakdown:')),
    found as (select c_custkey,
      unnest(regexp_extract_all(s, '  ([A-Z]+(?:-[A-Z]+)?):\n.*?Pass rate: ([\d.]+)%', 1, 's')) as wiki,
      unnest(regexp_extract_all(s, '  ([A-Z]+(?:-[A-Z]+)?):\n.*?Pass rate: ([\d.]+)%', 2, 's')) as rate from sections)
    select c_custkey, wiki, cast(rate as double) as pass_rate from found"""
)
def report_pass_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pass_rates(W.sql(spark, sf_dir, REPORT_TEXTS, "customer"))


DUMP_HITS = O.HITS.replace(O.ARTICLES, f"articles as ({W.DUMP_ARTICLES})")


@query(
    f"""with {DUMP_HITS}, {O.LANGUAGES}
    select upper(language) as wiki, cast(printf('%.2f', pass_rate) as double) as pass_rate from languages"""
)
def audit_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole audit: dumps to report, and the rates read back from the report."""
    run = run_audit(spark, W.dumps(spark, sf_dir), new_folder(spark, "audit"))
    return pass_rates(read_reports(spark, run.report_path)).drop("file")


@query(f"with {DUMP_HITS} select {', '.join(c if c not in ('article_title', 'article_url') else {'article_title': 'title as article_title', 'article_url': 'url as article_url'}[c] for c in FAILED_LIST.split(', '))} from hits where not is_valid")
def audit_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The failure table that the whole audit writes."""
    run = run_audit(spark, W.dumps(spark, sf_dir), new_folder(spark, "audit"))
    return read_failed_csv(spark, run.csv_path).drop("file", "row_id")


@query(f"select count(*) as articles, count(*) as rate_by_seconds from ({W.DUMP_ARTICLES}) a")
def audit_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of a run, and its rate times its seconds, which must be the articles again."""
    speed = run_audit(spark, W.dumps(spark, sf_dir)).speed()
    return speed.select("articles", F.round(F.col("articles_per_second") * F.col("seconds")).cast("long").alias("rate_by_seconds"))


# -- dumps ---------------------------------------------------------------------


@query(
    f"""select concat(language, 'wiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2') as dump_file,
    language, title, text, concat('https://', language, '.wikipedia.org/wiki/', replace(title, ' ', '_')) as url
    from ({W.DUMP_ARTICLES}) a"""
)
def dump_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.read_articles(spark, W.dumps(spark, sf_dir)).drop("part", "row_id")


@query(
    f"""select concat(language, 'wiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2') as dump_file,
    language, count(*) as articles_processed from ({W.DUMP_ARTICLES}) a group by all"""
)
def articles_per_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = D.read_articles(spark, W.dumps(spark, sf_dir))
    return S.articles_processed(articles, "dump_file", "language")


DAMAGED = "language = 'fr' and page_id % 100 = 5"


@query(
    f"""select language, title from ({W.DUMP_ARTICLES}) a
    where language not in (select language from ({W.ARTICLES}) b where {DAMAGED})"""
)
def drop_failed_dumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = W.dumps(spark, sf_dir, DAMAGED)
    return D.read_articles(spark, path, on_error="drop_dump").select("language", "title")


@query(f"select language, title from ({W.DUMP_ARTICLES}) a where not ({DAMAGED})")
def skip_broken_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = W.dumps(spark, sf_dir, DAMAGED)
    return D.read_articles(spark, path, on_error="skip_page").select("language", "title")


@query(
    f"""select distinct concat(language, 'wiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2') as file_name,
    '{W.NAMESPACE}' as namespace from ({W.ARTICLES}) a"""
)
def dump_namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.dump_namespaces(read_heads(spark, W.dumps(spark, sf_dir)))


@query(
    f"""select distinct language, '{W.DUMP_DATE}' as dump_date, true as bytes_agree from ({W.ARTICLES}) a"""
)
def dump_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each dump in the inventory beside those of the contents of its files."""
    path = W.dumps(spark, sf_dir)
    read = spark.read.format("binaryFile").option("pathGlobFilter", "*.bz2").load(path)
    held = read.groupBy(F.col("dump").cast("string").alias("file_name")).agg(F.sum(F.octet_length("content")).alias("held"))
    files = read_inventory(spark, path).groupBy("file_name", "language", "dump_date").agg(F.sum("length").alias("listed"))
    return files.join(held, "file_name").select("language", "dump_date", (F.col("listed") == F.col("held")).alias("bytes_agree"))


ELEMENTS = r"""select starts_with(url, 'https') as first,
 unnest(regexp_extract_all(html, '<(?:[\w.\-]+:)?([A-Za-z_][\w.\-]*)', 1)) as element from pages"""


@query(
    f"""select element, case when bool_or(first) and bool_or(not first) then 'common'
    when bool_or(first) then 'only_in_first' else 'only_in_second' end as side from ({ELEMENTS}) e group by element"""
)
def element_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.register(spark, sf_dir, "pages")
    return X.compare_elements(spark.table("pages"), "html", F.col("url").startswith("https"))


@query(
    f"""select element, case when bool_or(side = 'en') and bool_or(side = 'de') then 'common'
    when bool_or(side = 'en') then 'only_in_first' else 'only_in_second' end as side from (
      select language as side, unnest(['mediawiki', 'siteinfo', 'sitename']) as element from ({W.ARTICLES}) a
      union all
      select language, unnest(case when page_id % 11 = 0 then ['redirect'] else [] end
        || ['page', 'title', 'ns', 'revision', 'text']) from ({W.ARTICLES}) a) e
    where side in ('en', 'de') group by element"""
)
def dump_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = D.read_records(spark, W.dumps(spark, sf_dir))
    one, two = (
        records.filter(C.dump_language("dump_file") == code).select("value") for code in ("en", "de")
    )
    return X.compare_dump_structures(one, two, "value")


@query(
    f"""with p as (select language, page_id, row_number() over (partition by language order by page_id) as turn from ({W.ARTICLES}) a)
    select element, case when bool_or(side = 'en') and bool_or(side = 'de') then 'common'
    when bool_or(side = 'en') then 'only_in_first' else 'only_in_second' end as side from (
      select language as side, unnest(['mediawiki', 'siteinfo', 'sitename']) as element from p
      union all
      select language, unnest(case when page_id % 11 = 0 then ['redirect'] else [] end
        || ['page', 'title', 'ns', 'revision', 'text']) from p where turn <= 5) e
    where side in ('en', 'de') group by element"""
)
def dump_head_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the heads of the dumps, up to the end of their fifth page."""
    heads = read_heads(spark, W.dumps(spark, sf_dir))
    one, two = (heads.filter(C.dump_language("file_name") == code) for code in ("en", "de"))
    return X.compare_dump_structures(one, two)


# -- lists of languages and dumps ------------------------------------------------


@query(
    r"""select distinct code as language from (
      select unnest(regexp_extract_all(concat(url, ' ', html), '([a-z\-]+)\.example\.', 1)) as code from pages) c
    where not regexp_matches(code, 'wiki|www|meta|commons|species|data')"""
)
def page_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.register(spark, sf_dir, "pages")
    pages = spark.table("pages").select(F.concat("url", F.lit(" "), "html").alias("html"))
    return L.language_codes(pages, host=".example.")


LANGUAGE_PAGES = """
select c_custkey, concat('<a href="https://', translate(cast(c_custkey as varchar(20)), '0123456789', 'abcdefghij'),
 '.wikipedia.org/">x</a> <a href="//www.wikipedia.org/"></a> metadata.wikipedia.org zh-min-nan.wikipedia.org') as html
from customer
"""
PRESENT = """
select distinct translate(cast(o_custkey as varchar(20)), '0123456789', 'abcdefghij') as language from orders
where o_orderstatus = 'P' and o_orderpriority = '1-URGENT'
"""
WANTED = r"""select distinct language from (
 select unnest(regexp_extract_all(html, '([a-z\-]+)\.wikipedia\.org', 1)) as language from ({pages}) p) q
where not regexp_matches(language, 'wiki|www|meta|commons|species|data')""".replace("{pages}", LANGUAGE_PAGES)


def wanted_and_present(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = W.sql(spark, sf_dir, LANGUAGE_PAGES, "customer")
    return L.language_codes(pages), W.sql(spark, sf_dir, PRESENT, "orders")


@query(WANTED)
def wanted_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.language_codes(W.sql(spark, sf_dir, LANGUAGE_PAGES, "customer"))


@query(f"select language from ({WANTED}) w where language not in ({PRESENT})")
def missing_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.missing_languages(*wanted_and_present(spark, sf_dir))


@query(f"select language from ({WANTED}) w where language not in ({PRESENT}) order by language limit 20")
def plan_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.plan_listing(L.missing_languages(*wanted_and_present(spark, sf_dir)))


# One index page per customer with a link per order date; one page per date.
DATE_LINKS = """
select o_custkey, concat('20', lpad(cast((o_orderkey * 37 + o_custkey) % 100 as varchar(20)), 2, '0'),
        lpad(cast(1 + o_orderkey % 12 as varchar(20)), 2, '0'), lpad(cast(1 + o_custkey % 28 as varchar(20)), 2, '0')) as date,
 translate(cast(o_custkey as varchar(20)), '0123456789', 'abcdefghij') as language, o_orderkey, o_orderstatus, o_orderpriority
from orders
"""
INDEX_PAGES = f"""
select language, string_agg(concat('<a href="', date, '/">', date, '</a>'), chr(10)) as html from ({DATE_LINKS}) d group by language
"""
DATE_PAGES = f"""
select language, date,
 concat('<h1>', case when max(o_orderpriority) = '5-LOW' then 'Dump In-Progress' else 'done' end, '</h1>',
  case when min(o_orderstatus) = 'F' then '' else concat('<a href="', language, 'wiki-', date, '-pages-articles-multistream.xml.bz2">x</a>') end) as html
from ({DATE_LINKS}) d group by language, date
"""
LATEST = rf"""
with index_pages as ({INDEX_PAGES}), date_pages as ({DATE_PAGES}),
dates as (select language, unnest(regexp_extract_all(html, 'href="(\d{{8}})/"', 1)) as date from index_pages),
ranked as (select *, row_number() over (partition by language order by date desc) as r,
           max(date) over (partition by language) as newest from dates),
usable as (select distinct p.language, p.date from ranked r join date_pages p on p.language = r.language and p.date = r.date
  where r <= 5 and contains(p.html, concat(p.language, 'wiki-', p.date, '-pages-articles-multistream.xml.bz2'))
    and (not contains(lower(p.html), 'in-progress') or p.date <> newest))
select language, max(date) as date,
  concat('https://dumps.wikimedia.org/', language, 'wiki/', max(date), '/', language, 'wiki-', max(date), '-pages-articles-multistream.xml.bz2') as url
from usable group by language"""


@query(rf"select language, unnest(regexp_extract_all(html, 'href=\"(\d{{8}})/\"', 1)) as date from ({INDEX_PAGES}) i")
def dump_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.dump_dates(W.sql(spark, sf_dir, INDEX_PAGES, "orders"))


@query(LATEST)
def latest_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = W.sql(spark, sf_dir, INDEX_PAGES, "orders")
    return L.latest_dump(L.dump_dates(index), spark.sql(DATE_PAGES))


@query(
    f"""select m.language, l.date, l.url from (select language from ({WANTED}) w where language not in ({PRESENT})) m
    left join ({LATEST}) l on l.language = m.language"""
)
def dumps_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.register(spark, sf_dir, "orders", "customer")
    return fetch_list(
        spark.sql(LANGUAGE_PAGES), spark.sql(PRESENT), spark.sql(INDEX_PAGES), spark.sql(DATE_PAGES)
    )


@query(
    f"""select m.language, l.date, l.url from (select language from ({WANTED}) w where language not in ({PRESENT})) m
    left join ({LATEST}) l on l.language = m.language"""
)
def named_dumps_to_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for languages that the caller names."""
    W.register(spark, sf_dir, "orders", "customer")
    return fetch_list(None, spark.sql(PRESENT), spark.sql(INDEX_PAGES), spark.sql(DATE_PAGES), languages=L.language_codes(spark.sql(LANGUAGE_PAGES)))


INVENTORY = """
select doc_id, concat(lang, 'wiki-2025', lpad(cast(doc_id % 10000 as varchar(20)), 4, '0'), '-pages-articles', cast(doc_id as varchar(20)), '.xml.bz2') as file_name,
 n_chars * 100000 as length from documents
"""


@query(
    f"""select language, files, bytes, bytes / 2000 as estimated_articles, bytes / 2000 / 500 as estimated_seconds,
    case when h > 0 then concat(h, 'h ', m, 'm ', s, 's') when m > 0 then concat(m, 'm ', s, 's') else concat(s, 's') end as estimated_time
    from (select *, cast(floor(bytes / 1000000) as bigint) // 3600 as h, cast(floor(bytes / 1000000) as bigint) % 3600 // 60 as m,
                 cast(floor(bytes / 1000000) as bigint) % 60 as s
          from (select regexp_extract(file_name, '^([a-z\\-]+)wiki-', 1) as language, count(*) as files,
                       cast(sum(length) as bigint) as bytes from ({INVENTORY}) i group by 1) a) b"""
)
def inventory_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.inventory_sizing(with_codes(W.sql(spark, sf_dir, INVENTORY, "documents")))


@query(
    """select doc_id, case when s >= 60 then concat(s // 60, 'm ', s % 60, 's') else concat(s, 's') end as estimated_time
    from (select doc_id, cast(floor(n_chars * 10000 / 2000 / 500) as bigint) as s from documents) d"""
)
def processing_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    W.register(spark, sf_dir, "documents")
    size = F.col("n_chars") * 10000
    return spark.table("documents").select("doc_id", C.processing_time(size).alias("estimated_time"))


# -- streaming -------------------------------------------------------------------


@query(f"with {DUMP_HITS} select language, title, url, k, isbn, normalized, format, context, is_valid from hits")
def stream_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, checkpoint = new_folder(spark, "stream-hits"), new_folder(spark, "stream-state")
    append_new_hits(spark, W.dumps(spark, sf_dir), output, checkpoint).awaitTermination()
    return spark.read.parquet(output).drop("dump_file", "part", "row_id")


@query(f"select language, count(*) as articles_processed from ({W.DUMP_ARTICLES}) a group by language")
def stream_article_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    output, checkpoint = new_folder(spark, "stream-counts"), new_folder(spark, "stream-state")
    update_article_counts(spark, W.dumps(spark, sf_dir), output, checkpoint).awaitTermination()
    return read_article_counts(spark, output)


# -- the growing ledger ------------------------------------------------------------


def followed(spark: SparkSession, dumps_dir: str) -> Ledger:
    """The ledger of a stream that takes the dumps of a folder in several batches."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    follow_dumps(spark, dumps_dir, ledger, new_folder(spark, "ledger-state"), files_per_batch=3).awaitTermination()
    return ledger


@query(
    f"""with {DUMP_HITS} select language, title, url, k, isbn, normalized, format, context, is_valid from hits
    where language not in (select language from ({W.ARTICLES}) b where {DAMAGED})"""
)
def stream_drop_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a stream over dumps one of which has malformed pages: whole dumps only."""
    return followed(spark, W.dumps(spark, sf_dir, DAMAGED)).hits().drop("dump_file", "part", "row_id")


@query(f"with {DUMP_HITS} {O.TOTALS}")
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals folded from the partial counts of several batches."""
    return followed(spark, W.dumps(spark, sf_dir)).totals()


@query(f"with {DUMP_HITS} {O.TOTALS}")
def resumed_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of an audit that took one dump first and the others in a second run, each dump once."""
    path, folder = W.dumps(spark, sf_dir), new_folder(spark, "ledger")
    first = Ledger(spark, folder).add(path, [f"enwiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2"])
    second = Ledger(spark, folder)
    if not first or set(first) & set(second.add(path)):
        raise RuntimeError("a dump was read twice")
    return second.totals()


@query(
    f"""select language, concat(language, 'wiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2') as dump_file,
    case when bool_or({DAMAGED}) then 'broken' else 'good' end as state from ({W.ARTICLES}) a group by language"""
)
def dump_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state in which the ledger found each dump."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    ledger.add(W.dumps(spark, sf_dir, DAMAGED))
    return ledger.dumps().select("language", "dump_file", "state")


@query(
    f"""select concat(language, 'wiki-{W.DUMP_DATE}-pages-articles-multistream.xml.bz2') as dump_file,
    count(*) as articles, true as has_speed from ({W.DUMP_ARTICLES}) a group by language"""
)
def observed_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of each dump as observed in the pass that writes the ledger, and whether its speed follows from them."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    ledger.add(W.dumps(spark, sf_dir), share_bytes=1)
    speed = ledger.speed().where(F.abs(F.col("articles_per_second") * F.col("seconds") - F.col("articles")) < 1e-3 * F.col("articles"))
    found = ledger.dumps().select("dump_file", "batch", "articles").join(speed.select("batch", F.lit(True).alias("has_speed")), "batch", "left")
    return found.select("dump_file", "articles", F.coalesce("has_speed", F.lit(False)).alias("has_speed"))


@query(
    f"""with {DUMP_HITS} select language, count(distinct unique_form) filter (where is_valid) as unique_valid,
    count(distinct unique_form) filter (where not is_valid) as unique_invalid, true as within_bound from hits group by language"""
)
def sketched_uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact distinct ISBNs of each language, and whether the united sketches of its dumps come within 5 %."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    ledger.add(W.dumps(spark, sf_dir), share_bytes=1)
    about = ledger.approx_uniques("language").select("language", *[F.col(f"unique_{c}").alias(c) for c in ("valid", "invalid")])
    exact = S.language_breakdown(ledger.rollup()).select("language", "unique_valid", "unique_invalid").join(about, "language")
    near = [F.abs(F.col(c) - F.col(f"unique_{c}")) <= 1 + 0.05 * F.col(f"unique_{c}") for c in ("valid", "invalid")]
    return exact.select("language", "unique_valid", "unique_invalid", (near[0] & near[1]).alias("within_bound"))


@query(f"with {DUMP_HITS} select title, k, isbn, is_valid from hits where language = 'de'")
def hits_of_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one language, from its folder of the ledger alone."""
    ledger = Ledger(spark, new_folder(spark, "ledger"))
    ledger.add(W.dumps(spark, sf_dir))
    return ledger.hits("de").select("title", "k", "isbn", "is_valid")


@query(
    f"""select element, string_agg(distinct side, ',' order by side) as dumps, count(distinct side) as n_dumps from (
      select language as side, unnest(['mediawiki', 'siteinfo', 'sitename']) as element from ({W.ARTICLES}) a
      union all
      select language, unnest(case when page_id % 11 = 0 then ['redirect'] else [] end
        || ['page', 'title', 'ns', 'revision', 'text']) from ({W.ARTICLES}) a) e group by element"""
)
def structure_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which dumps each element occurs, from one bitmap per element over all dumps."""
    records = D.read_records(spark, W.dumps(spark, sf_dir))
    named = records.select(C.dump_language("dump_file").alias("dump"), "value")
    matrix = X.structure_matrix(named, "value", "dump")
    return X.dumps_of(matrix).select("element", F.array_join("dumps", ",").alias("dumps"), F.col("n_dumps").cast("long"))


@query(
    f"""select element, case when bool_or(side = 'fr') and bool_or(side = 'de') then 'common'
    when bool_or(side = 'fr') then 'only_in_first' else 'only_in_second' end as side from (
      select language as side, unnest(['mediawiki', 'siteinfo', 'sitename']) as element from ({W.ARTICLES}) a
      union all
      select language, unnest(case when page_id % 11 = 0 then ['redirect'] else [] end
        || ['page', 'title', 'ns', 'revision', 'text']) from ({W.ARTICLES}) a) e
    where side in ('fr', 'de') group by element"""
)
def compared_by_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of all dumps compared by their bits, without reading them again."""
    records = D.read_records(spark, W.dumps(spark, sf_dir))
    matrix = X.structure_matrix(records.select(C.dump_language("dump_file").alias("dump"), "value"), "value", "dump")
    return X.compare_by_matrix(matrix, "fr", "de")
