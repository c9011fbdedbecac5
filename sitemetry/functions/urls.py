"""URL normalisation and predicates as columns, for absolute http(s) URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE

UTILITY_PATH = r"(?i)^/(about|contact|privacy|terms|legal|tos|login|register|signup)([/?#]|$)"


def scheme_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority_of(url: Column) -> Column:
    """Host and port in lower case, without credentials and without the scheme's default port."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    port = F.when(scheme_of(url) == "http", r":80$").when(scheme_of(url) == "https", r":443$").otherwise("$^")
    return F.regexp_replace(host, port, F.lit(""))


def hostname_of(url: Column) -> Column:
    return F.regexp_replace(authority_of(url), r":[0-9]*$", "")


def path_of(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def query_of(url: Column) -> Column:
    """With its question mark, '' if none."""
    return F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)


def is_http(url: Column) -> Column:
    return F.coalesce(scheme_of(url).isin("http", "https") & (hostname_of(url) != ""), F.lit(False))


def _escaped(value: Column, bad: str) -> Column:
    """Percent escapes for the characters that ``bad`` matches."""
    code = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
    each = F.transform(F.regexp_extract_all(value, F.lit("(?s)(.)"), F.lit(1)), lambda c: F.when(c.rlike(bad), code(c)).otherwise(c))
    return F.when(value.rlike(bad), F.array_join(each, "")).otherwise(value)


def _without_dots(path: Column) -> Column:
    """The path with its ``.`` and ``..`` segments resolved."""

    def step(done: Column, part: Column) -> Column:
        up, here = part.rlike(r"(?i)^(\.|%2e){2}$"), part.rlike(r"(?i)^(\.|%2e)$")
        return F.when(up, F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).when(here, done).otherwise(F.concat(done, F.array(part)))

    parts = F.aggregate(F.split(F.substring(path, 2, 2**31 - 1), "/"), F.array().cast("array<string>"), step)
    ends = F.when(path.rlike(r"(?i)/(\.|%2e){1,2}$") & (F.size(parts) > 0), "/").otherwise("")
    return F.when(path.rlike(r"(?i)/(\.|%2e)"), F.concat(F.lit("/"), F.array_join(parts, "/"), ends)).otherwise(path)


def _whole_url(url: Column, path: Column) -> Column:
    credentials = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#@]*@)", 1)
    return F.concat(scheme_of(url), F.lit("://"), credentials, authority_of(url), _escaped(path, r"[^\x21-\x7e]|[\"<>`{}]"), _escaped(query_of(url), r"[^\x21-\x7e]|[\"<>']"))


def norm_crawl_url(url: Column) -> Column:
    """Without fragment, default port and trailing slashes of the path; dots resolved, blanks and other
    characters escaped; query and credentials stay. Null if not http(s). ``html.normal_url`` has the same rules."""
    path = F.regexp_replace(_without_dots(path_of(url)), "/+$", "")
    return F.when(is_http(url), _whole_url(url, F.when(path == "", "/").otherwise(path)))


def joined(href: Column, base: Column) -> Column:
    """``href`` as an absolute URL, seen from ``base``."""
    href, start = F.trim(href), F.concat(scheme_of(base), F.lit("://"), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    folder = F.regexp_replace(path_of(base), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme_of(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(start, href))
        .when(F.startswith(href, F.lit("?")), F.concat(start, path_of(base), href))
        .when((href == "") | F.startswith(href, F.lit("#")), F.concat(start, path_of(base), query_of(base)))
        .otherwise(F.concat(start, folder, href))
    )


def redirect_target(location: Column, base: Column, domain: Column) -> Column:
    """Where a redirect inside the domain leads: the path stays as it is, with its trailing slash; else null."""
    url = joined(location, base)
    return F.when(is_http(url) & within_domain(hostname_of(url), domain), _whole_url(url, _without_dots(path_of(url))))


def within_domain(host: Column, domain: Column) -> Column:
    root = F.lower(domain)
    return (F.lower(host) == root) | F.endswith(F.lower(host), F.concat(F.lit("."), root))


def norm_internal_link(url: Column, domain: Column) -> Column:
    """A normalised absolute link inside the domain, else null."""
    return F.when(within_domain(hostname_of(url), domain), norm_crawl_url(url))


def internal_link(href: Column, base: Column, domain: Column) -> Column:
    """The normalised target of ``href`` on the page ``base`` inside the domain, else null. ``html.internal_link`` has the same rules."""
    return norm_internal_link(joined(href, base), domain)


def origin_of(url: Column) -> Column:
    return F.when(is_http(url), F.concat(scheme_of(url), F.lit("://"), authority_of(url)))


def website_url_error(value: Column) -> Column:
    """Why a project's URL is refused; null if it isn't."""
    url = F.regexp_replace(F.coalesce(value, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    credentials = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)@", 1)
    return (
        F.when(url == "", "Website URL is required")
        .when(scheme_of(url) == "", "Invalid website URL")
        .when(~scheme_of(url).isin("http", "https"), "Website URL must use HTTP or HTTPS")
        .when(credentials != "", "Website URL must not contain credentials")
        .when((hostname_of(url) == "") | F.contains(hostname_of(url), F.lit(" ")), "Invalid website URL")
    )


def norm_website_url(value: Column) -> Column:
    """Scheme, host and path without trailing slashes; null where ``website_url_error`` has a reason."""
    url = F.regexp_replace(F.coalesce(value, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(website_url_error(value).isNull(), F.concat(scheme_of(url), F.lit("://"), authority_of(url), F.regexp_replace(path_of(url), "/+$", "")))


def website_domain(value: Column) -> Column:
    url = F.regexp_replace(F.coalesce(value, F.lit("")), rf"^{SPACE}+|{SPACE}+$", "")
    return F.when(website_url_error(value).isNull(), F.regexp_replace(hostname_of(url), r"^www\.", ""))


def slug_phrase(url: Column) -> Column:
    """Words of the path: separators and other characters become single spaces."""
    path = F.when(scheme_of(url) == "", F.lit("")).otherwise(path_of(url))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "[_-]+", " "), r"[^A-Za-z0-9\s-]", " "), r"\s+", " "))


def is_utility_page(url: Column) -> Column:
    return F.coalesce((scheme_of(url) != "") & path_of(url).rlike(UTILITY_PATH), F.lit(False))


def site_hostname(property_url: Column) -> Column:
    """Host of a metrics property, ``sc-domain:`` or URL, without ``www.``; null if neither."""
    value = F.trim(property_url)
    bare = F.regexp_replace(value, "^sc-domain:", "")
    url = F.when(F.startswith(value, F.lit("sc-domain:")) & ~F.contains(bare, F.lit("://")), F.concat(F.lit("https://"), bare)).otherwise(bare)
    host = F.regexp_replace(hostname_of(url), r"^www\.", "")
    return F.when(host != "", host)


def host_label(url: Column) -> Column:
    """First label of the host minus ``www.``."""
    return F.regexp_extract(F.regexp_replace(hostname_of(url), r"^www\.", ""), r"^([^.]*)", 1)


def link_key(url: Column) -> Column:
    """Host and path, the identity of a page in the link graph."""
    return F.concat(hostname_of(url), F.regexp_replace(path_of(url), "/+$", ""))
