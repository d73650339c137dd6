"""Column expressions on URLs, e-mail addresses and search hits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that marks an absolute URL, default scheme, e-mail domain pattern,
# separator in search hits.
SCHEME_MARK = "http"
DEFAULT_SCHEME = "http://"
EMAIL_DOMAIN = "@([A-Za-z.]+)"
HIT_SEPARATOR = "›"

# Marks of companies without one clear website.
NO_DATA = "No Data"
NEEDS_CHECKING = "Needs Checking"


def fix_http(url: Column) -> Column:
    """Scheme in front, '/' at the end; blank and null URLs give null."""
    schemed = F.when(url.contains(SCHEME_MARK), url).otherwise(F.concat(F.lit(DEFAULT_SCHEME), url))
    slashed = F.when(schemed.endswith("/"), schemed).otherwise(F.concat(schemed, F.lit("/")))
    return F.when(url != "", slashed)


def url_from_email(email: Column) -> Column:
    """Domain after the first '@' that is followed by letters or dots, else ''."""
    return F.coalesce(F.regexp_extract(email, EMAIL_DOMAIN, 1), F.lit(""))


def assign_primary_url(cur_web: Column, cur_email: Column, web: Column, email: Column) -> Column:
    """The first contact field that is filled, as a URL.

    A filled e-mail without a domain ends the search and gives null; no field filled gives ''.
    """
    return (
        F.when(cur_web.isNotNull(), fix_http(cur_web))
        .when(cur_email.isNotNull(), fix_http(url_from_email(cur_email)))
        .when(web.isNotNull(), fix_http(web))
        .when(email.isNotNull(), fix_http(url_from_email(email)))
        .otherwise(F.lit(""))
    )


def fill_best_guess(best_guess: Column, found: Column) -> Column:
    """Replace a blank guess by the website found by hand; a missing find stays null."""
    return F.when(best_guess == "", fix_http(found)).otherwise(best_guess)


def website_source(cur_web: Column, web: Column) -> Column:
    """Four-way choice between the registry website and the one the company gave."""
    return (
        F.when(cur_web.isNotNull() & web.isNotNull(), F.lit(NEEDS_CHECKING))
        .when(web.isNotNull(), web)
        .when(cur_web.isNotNull(), cur_web)
        .otherwise(F.lit(NO_DATA))
    )


def needs_check(source: Column) -> Column:
    return source.isin(NO_DATA, NEEDS_CHECKING)


def resolve_link(base: Column, href: Column, absolute_mark: str = SCHEME_MARK) -> Column:
    """Absolute links as they are; others are put behind the page URL without outer dots."""
    relative = F.concat(base, F.regexp_replace(href, r"^\.+|\.+$", ""))
    return F.when(href.contains(absolute_mark), href).otherwise(relative)


def hit_site(hit: Column) -> Column:
    """Site part of a search hit."""
    return F.regexp_replace(F.substring_index(hit, HIT_SEPARATOR, 1), r"\s+$", "")


def search_phrase(name: Column) -> Column:
    """Company name with single blanks and no line breaks."""
    return F.regexp_replace(F.regexp_replace(name, " +", " "), "\n", "")


def street_name(street: Column) -> Column:
    """Street without house numbers and bracketed parts."""
    no_digits = F.trim(F.regexp_replace(street, r"\d+", ""))
    return F.regexp_replace(no_digits, r"[(\[].*?[)\]]", "")
