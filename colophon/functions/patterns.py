"""Fixed values of the ISBN audit: patterns, constants, labels.

They define the result, so they are stated once, as plain text.  The regular
expressions are written for the JVM.  ``(?U)`` gives ``\\d`` and ``\\s`` their
Unicode meaning; ``\\x1c-\\x1f`` are the four separators that Unicode text tools
treat as white space and the JVM does not.
"""

# -- fixed values -----------------------------------------------------------
URL = r"""(?U)https?://[^\s\x1c-\x1f<>"{}|\\^`\[\]]+"""

# A run of digits, hyphens and white space that starts and ends like an ISBN.
RUN = r"\d[\d\-\s\x1c-\x1f]{8,16}[\dXx]"
NOT_AFTER_DIGIT = r"(?<![0-9])"
NOT_BEFORE_WORD = r"(?![\p{L}\p{N}_])"
CANDIDATE = rf"(?U){NOT_AFTER_DIGIT}({RUN}){NOT_BEFORE_WORD}"

SHAPE = r"\A(?:[0-9]{9}[0-9X]|[0-9]{13})\z"
SHAPE_10 = r"\A[0-9]{9}[0-9X]\z"
SHAPE_13 = r"\A[0-9]{13}\z"
KEYWORD = "isbn"
KEYWORD_ANY_CASE = "[iI][sS][bB][nN]"

DEFAULT_CONTEXT = 50
DEFAULT_PROXIMITY = 6

ISBN10_WEIGHTS = (10, 9, 8, 7, 6, 5, 4, 3, 2, 1)
ISBN13_WEIGHTS = (1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1, 3, 1)
FORMAT_10 = "ISBN-10"
FORMAT_13 = "ISBN-13"
FORMAT_OTHER = "Invalid (%d digits)"

DUMP_LANGUAGE = r"\A([a-z]+)wiki-"
DEFAULT_LANGUAGE = "en"
INVENTORY_LANGUAGE = r"\A([a-z\-]+)wiki-"
INVENTORY_DATE = r"wiki-(\d{8})-"
INVENTORY_NAME = r"wiki-.*-pages-articles.*\.bz2\z"
DUMP_GLOB = "*.bz2"
DUMP_SUFFIX = "-pages-articles-multistream.xml.bz2"
DUMP_SITE = "https://dumps.wikimedia.org/"
ARTICLE_HOST = ".wikipedia.org"
ARTICLE_PATH = "/wiki/"

NOT_A_LANGUAGE = ("wiki", "www", "meta", "commons", "species", "data")
DATE_LINK = r'href="(\d{8})/"'
IN_PROGRESS = "in-progress"
NEWEST_DATES_TRIED = 5
PLAN_LISTING = 20

XML_NAMESPACE = r'xmlns="([^"]*)"'
XML_ELEMENT = r"<(?:[\w.\-]+:)?([A-Za-z_][\w.\-]*)"
ELEMENT_PAGES = 5

REPORT_SECTION = "Language Breakdown:"
REPORT_LANGUAGE = r"(?s)  ([A-Z]+(?:-[A-Z]+)?):\n.*?Pass rate: ([\d.]+)%"

BYTES_PER_ARTICLE = 2000
ARTICLES_PER_SECOND = 500
TOP_ARTICLES = 10

FAILED_COLUMNS = (
    "article_title", "language", "isbn", "format", "context", "article_url",
)
UNKNOWN_FORMAT = "Unknown"
UNKNOWN_LANGUAGE = "unknown"
UNKNOWN_TITLE = "Unknown"
