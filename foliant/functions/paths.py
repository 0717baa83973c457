"""Portable paths and the dimensions that folders give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def portable(path: Column) -> Column:
    """Backslashes to slashes, slashes at both ends stripped."""
    return F.trim(F.regexp_replace(path, r"\\", "/"), F.lit("/"))


def is_portable(path: Column) -> Column:
    """Relative, without NUL, drive letters, empty, '.' or '..' segments."""
    parts = F.split(path, "/")
    return (F.length(path) > 0) & ~path.contains(":") & ~path.contains("\x00") & F.forall(parts, lambda p: (F.length(p) > 0) & (p != ".") & (p != ".."))


def url_path(url: Column) -> Column:
    """host/segments of a URL without its scheme, query, fragment and closing slashes."""
    return portable(F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://", ""), r"[?#].*$", ""))


def segment(path: Column, n: int) -> Column:
    """The n-th segment, or the empty text."""
    return F.coalesce(F.try_element_at(F.split(path, "/"), F.lit(n)), F.lit(""))


def ancestors(path: Column) -> Column:
    """All proper ancestors, nearest last; none for a top-level name."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).otherwise(F.array().cast("array<string>"))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def classify_root(path: Column, minimum_year: int = 2016) -> Column:
    """service, year, customer and city of a path service/year/customer[, city]/...; null where it is no project root."""
    year, label = segment(path, 2), segment(path, 3)
    name, city = F.trim(F.substring_index(label, ",", 1)), F.trim(F.when(label.contains(","), F.expr("''")).otherwise(F.lit("")))
    city = F.when(label.contains(","), F.trim(F.regexp_replace(label, r"^[^,]*,", ""))).otherwise(city)
    good = year.rlike(r"^[0-9]{4}$") & (F.try_to_number(year, F.lit("9999")) >= minimum_year) & (F.length(name) > 0)
    return F.when(good, F.struct(segment(path, 1).alias("service"), year.alias("year"), name.alias("customer"), city.alias("city")))


def legacy_path(path: Column) -> Column:
    """Drive, UNC and absolute paths as portable ones below legacy-c, unc-host-share or legacy-posix."""
    p = F.regexp_replace(path, r"\\", "/")
    drive, unc = F.regexp_extract(p, r"^([A-Za-z]):/(.*)$", 1), F.regexp_extract(p, r"^//([^/]+)/([^/]+)/(.*)$", 1)
    return (
        F.when(drive != "", F.concat(F.lit("legacy-"), F.lower(drive), F.lit("/"), F.regexp_extract(p, r"^([A-Za-z]):/(.*)$", 2)))
        .when(unc != "", F.concat(F.lit("unc-"), F.lower(unc), F.lit("-"), F.lower(F.regexp_extract(p, r"^//([^/]+)/([^/]+)/(.*)$", 2)), F.lit("/"), F.regexp_extract(p, r"^//([^/]+)/([^/]+)/(.*)$", 3)))
        .when(p.startswith("/"), F.concat(F.lit("legacy-posix"), p))
        .otherwise(p)
    )


def parse_directory(path: Column, source: Column) -> Column:
    """name, parent, domain_folder, time_bucket and project_name of a folder; the top folder is named after its source and has no parent."""
    parts = F.filter(F.split(portable(path), "/"), lambda p: p != "")
    parent = F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    name = F.when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise(source)
    at = lambda n: F.coalesce(F.get(parts, F.lit(n)), F.lit(""))
    return F.struct(name.alias("name"), parent.alias("parent"), at(0).alias("domain_folder"), at(1).alias("time_bucket"), at(2).alias("project_name"))


def parse_file(path: Column, source: Column) -> Column:
    """What parse_directory says of the folder that a file lies in."""
    return parse_directory(folder(portable(path)), source)


def source_uri(source: Column, path: Column) -> Column:
    """source://id/path, percent-encoded but for slashes and unreserved characters."""
    encoded = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.url_encode(path), r"\+", "%20"), "%2F", "/"), "%7E", "~")
    return F.concat(F.lit("source://"), source, F.lit("/"), F.regexp_replace(encoded, r"\*", "%2A"))


def from_source_uri(uri: Column) -> Column:
    """source and path of such a URI; null for other texts."""
    found = uri.rlike(r"^source://[^/]+(/|$)")
    path = F.regexp_replace(F.regexp_extract(uri, r"^source://[^/]+/?([^?#]*)", 1), r"\+", "%2B")
    return F.when(found, F.struct(F.regexp_extract(uri, r"^source://([^/]+)", 1).alias("source"), F.trim(F.url_decode(path), F.lit("/")).alias("path")))
