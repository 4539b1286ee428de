"""URL expressions that never fail on malformed input."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":\d*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(F.trim(url), r"^[^?#]*\?([^#]*)", 1)


def without_port(url: Column) -> Column:
    return F.when(scheme(url) == "http", F.regexp_replace(authority(url), ":80$", "")).otherwise(F.regexp_replace(authority(url), ":443$", ""))


def trimmed_path(url: Column) -> Column:
    bare = F.regexp_replace(path(url), "/+$", "")
    return F.when(bare == "", "/").otherwise(bare)


def normalize(url: Column) -> Column:
    """http and https only, else null: no fragment, no default port, lower-case host, no slash at the end, query kept."""
    asked = query(url)
    full = F.concat(scheme(url), F.lit("://"), without_port(url), trimmed_path(url), F.when(asked != "", F.concat(F.lit("?"), asked)).otherwise(""))
    return F.when(scheme(url).isin("http", "https") & (authority(url) != ""), full)


def canonical(url: Column) -> Column:
    """Another identity: no query either, and no slash for an empty path."""
    return F.when(scheme(url) != "", F.concat(scheme(url), F.lit("://"), authority(url), F.regexp_replace(path(url), "/+$", "")))


def origin(url: Column) -> Column:
    usable = scheme(url).isin("http", "https") & (host(url) != "") & ~authority(url).contains("@")
    return F.when(usable, F.concat(scheme(url), F.lit("://"), without_port(url)))


def origin_id(url: Column) -> Column:
    return F.concat(F.lit("o_"), F.sha2(origin(url), 256))


def company(url: Column) -> Column:
    """'Meta' for fb.com and any host with 'meta' in it, else the host with its port."""
    at = authority(url)
    return F.when(at.contains("meta") | (at == "fb.com"), "Meta").otherwise(at)


def resolve(base: Column, link: Column) -> Column:
    """A link as seen from a page; null for mail, phone, script and fragment links."""
    root = F.concat(scheme(base), F.lit("://"), authority(base))
    folder = F.concat(root, F.when(path(base) == "", "/").otherwise(F.regexp_replace(path(base), "[^/]*$", "")))
    href = F.trim(link)
    return F.when(href.rlike(r"(?i)^(mailto:|tel:|javascript:|#)") | (href == ""), None).when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href).when(href.startswith("//"), F.concat(scheme(base), F.lit(":"), href)).when(
        href.startswith("/"), F.concat(root, href)
    ).when(href.startswith("?"), F.concat(root, path(base), href)).otherwise(F.concat(folder, href))
