"""Column functions on text, URLs, dates and identifiers. All are built-in expressions; null in gives null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def netloc(url: Column) -> Column:
    """Authority of a URL, port included; null where there is none."""
    return F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#\s]*)", 1), F.lit(""))


def host(url: Column) -> Column:
    """Host name in lower case without port and a leading ``www.``."""
    return F.regexp_replace(F.regexp_replace(F.lower(netloc(url)), r":\d*$", ""), r"^www\.", "")


def path_slug(url: Column, most: int = 120) -> Column:
    """The URL's path as an identifier: everything but letters, digits and ``_`` becomes ``_``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*([^?#]*)", 1)
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(path), r"[^\p{L}\p{N}_]", "_"), r"^_+|_+$", ""), 1, most)


def year_in_url(url: Column) -> Column:
    """``YYYY-01-01`` of the first year from 2000 to 2099 in a URL, empty where there is none."""
    year = F.regexp_extract(url, r"(20\d{2})", 1)
    return F.when(year != "", F.concat(year, F.lit("-01-01"))).otherwise(F.when(url.isNotNull(), F.lit("")))


def pdf_date(raw: Column) -> Column:
    """``D:YYYYMMDD...`` -> ``YYYY-MM-DD`` by position; empty unless eight characters follow."""
    body = F.regexp_replace(raw, r"^D:", "")
    iso = F.concat_ws("-", F.substring(body, 1, 4), F.substring(body, 5, 2), F.substring(body, 7, 2))
    return F.when(raw.isNull(), F.lit(None)).otherwise(F.when(F.length(body) >= 8, iso).otherwise(F.lit("")))


def year_of(date: Column) -> Column:
    """The year that a date string begins with; null where it doesn't."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def chunk_hash(url: Column, index: Column, text: Column) -> Column:
    """SHA-256 of the URL, the chunk's index and its first 100 characters."""
    return F.sha2(F.concat(F.coalesce(url, F.lit("")), index.cast("string"), F.substring(text, 1, 100)), 256)


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case words of letters, digits and ``_`` with at least ``least`` characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1)), lambda t: F.length(t) >= least)


def token_id(token: Column) -> Column:
    """CRC-32 of a token as an unsigned number."""
    return F.crc32(F.encode(token, "UTF-8"))


def links(html: Column) -> Column:
    """All ``href`` values of anchors."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*?\shref\s*=\s*"([^"]+)"'), F.lit(1))


def absolute(base: Column, link: Column) -> Column:
    """A link resolved against its page: absolute ones stay, ``//host`` gets the scheme, ``/path`` the authority."""
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(://[^/]*(?:/.*)?/)[^/]*$", "$1")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def first_percent(html: Column) -> Column:
    """The first rate of a page: the number before ``<sub>%</sub>``, else the first decimal number before a percent sign."""
    marked = F.nullif(F.regexp_extract(html, r"([0-9]+(?:[.,][0-9]+)?)\s*<sub>\s*%\s*</sub>", 1), F.lit(""))
    plain = F.nullif(F.regexp_extract(F.regexp_replace(html, r"<[^>]*>", " "), r"(\d+[,.]\d+)\s*%", 1), F.lit(""))
    return F.coalesce(marked, plain)


def page_blocks(text: Column) -> Column:
    """Texts between ``--- Page N ---`` lines, stripped, blank ones left out."""
    return F.filter(F.transform(F.split(text, r"(?m)^\s*--- Page \d+ ---\s*$"), strip), lambda x: x != "")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, without quotes around it."""
    return F.get(F.filter(F.transform(F.split(text, r"\R"), lambda x: F.regexp_replace(strip(x), "^[\"'„”]+|[\"'„”]+$", "")), lambda x: x != ""), F.lit(0))


def without_fence(text: Column) -> Column:
    """Model output without a code fence around it, ready for ``from_json``."""
    return F.regexp_replace(strip(text), r"^```[A-Za-z]*\s*|\s*```$", "")


def contains_any(text: Column, patterns: Column) -> Column:
    """Whether the text holds any of the literal patterns, ignoring case; false for no patterns."""
    return F.exists(patterns, lambda p: F.contains(F.lower(text), F.lower(p)))


def same_authority(url: Column, other: Column) -> Column:
    """Whether two URLs have the same authority, ports included; false where either has none."""
    return F.coalesce(netloc(url) == netloc(other), F.lit(False))


def first_sufficient(levels: dict[str, Column], least: int = 50) -> Column:
    """The first extraction level (arrays of page texts) with a page of at least ``least`` characters, else the last one.

    Gives a struct of ``method`` and ``pages``; nulls where the last level is null too.
    """
    *tried, last = levels.items()
    enough = lambda pages: F.coalesce(F.exists(pages, lambda p: F.coalesce(F.length(strip(p)) >= least, F.lit(False))), F.lit(False))
    row = lambda name, pages: F.struct(F.lit(name).alias("method"), pages.alias("pages"))
    out = F.when(last[1].isNotNull(), row(*last))
    for name, pages in reversed(tried):
        out = F.when(enough(pages), row(name, pages)).otherwise(out)
    return out


def replace_terms(text: Column, terms: dict[str, str]) -> Column:
    """Text with whole words of a glossary replaced, longer terms first."""
    for term in sorted(terms, key=lambda t: (-len(t), t)):
        quoted = "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in term)
        text = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])", terms[term].replace("\\", "\\\\").replace("$", "\\$"))
    return text
