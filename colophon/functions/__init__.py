"""Column functions: everything here takes and returns a Column."""

from colophon.functions.checksum import (
    format_of_length,
    is_isbn_shaped,
    isbn_format,
    isbn_holds,
    isbn_number,
    validate_isbn,
    validate_isbn10,
    validate_isbn13,
)
from colophon.functions.detect import (
    candidate_starts,
    candidate_values,
    find_potential_isbns,
    has_isbn_nearby,
    hit_windows,
    may_hold_isbn,
    Windows,
)
from colophon.functions.labels import (
    article_url,
    dump_language,
    fixed,
    inventory_date,
    inventory_language,
    language_label,
    pass_rate,
    processing_seconds,
    processing_time,
    speed,
    thousands,
)
from colophon.functions.text import (
    bare_isbn,
    fold_digits,
    normalize_isbn,
    strip_separators,
    strip_urls,
    trim_space,
)

__all__ = [
    "article_url", "bare_isbn", "Windows", "candidate_starts", "candidate_values", 
    "dump_language", "find_potential_isbns", "fixed", "fold_digits", "format_of_length",
    "has_isbn_nearby", "hit_windows", "inventory_date", "inventory_language", "is_isbn_shaped",
    "isbn_format", "isbn_holds", "isbn_number", "language_label", "may_hold_isbn", "normalize_isbn",
    "pass_rate", "processing_seconds", "processing_time", "speed",
    "strip_separators", "strip_urls", "thousands", "trim_space",
    "validate_isbn", "validate_isbn10", "validate_isbn13",
]
