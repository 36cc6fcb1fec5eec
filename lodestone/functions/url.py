"""URL identity as column expressions: canonical keys, classes, shape, archive editions.

Every function takes a string column and stays inside the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that never change the page, index files, extensions.
TRACKING_PREFIXES = ("utm_", "pk_", "piwik_")
TRACKING_KEYS = (
    "fbclid", "gclid", "gbraid", "wbraid", "dclid", "msclkid", "yclid", "twclid", "ttclid", "igshid", "mc_cid", "mc_eid",
    "_ga", "_gl", "ref_src", "ref_url", "scid", "vero_id", "wickedid", "oly_anon_id", "oly_enc_id", "__s", "rb_clickid", "s_cid",
)
SESSION_KEYS = ("sessionid", "session_id", "jsessionid", "phpsessid", "aspsessionid", "sid")
INDEX_FILES = ("index.html", "index.htm", "index.php", "index.asp", "index.aspx", "default.aspx")
HOST_PREFIX = r"^(www\.|m\.|mobile\.|amp\.)"
IMAGES = ("jpg", "jpeg", "png", "gif", "svg", "webp", "bmp", "ico", "tif", "tiff", "avif", "heic")
MEDIA = ("mp4", "webm", "mov", "avi", "mkv", "mp3", "wav", "ogg", "flac", "m4a", "m4v", "wmv")
ARCHIVES = ("zip", "gz", "tgz", "bz2", "xz", "7z", "rar", "tar", "iso", "dmg")
BINARY_DOCUMENTS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "epub")

#: scheme, authority, path, query: the authority runs to the first slash, whatever else it holds.
PARTS = r"^([^#]+?)://([^/#]*)(/[^?#]*)?(\?[^#]*)?"


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(url), PARTS, group)


def _is_url(url: Column) -> Column:
    return F.trim(url).rlike(r"^[^#]+?://[^#]") & (host(url) != "")


def _authority(url: Column) -> Column:
    return F.regexp_replace(_part(url, 2), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-cased host without user info and port; a literal in brackets keeps its colons."""
    a = _authority(url)
    return F.lower(F.when(a.contains("]"), a).otherwise(F.regexp_replace(a, r":[^:]*$", "")))


def _port(url: Column) -> Column:
    a = _authority(url)
    port = F.when(a.contains("]") | ~a.contains(":"), "").otherwise(F.regexp_extract(a, r":([^:]*)$", 1))
    return F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))


def _path(url: Column) -> Column:
    path = _part(url, 3)
    return F.when(path == "", "/").otherwise(path)


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _resolved(path: Column) -> Column:
    """Segments with ``.`` dropped and ``..`` taking back the one before; no index file at the end."""
    kept = F.aggregate(
        F.filter(_segments(path), lambda s: s != "."),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(s))),
    )
    last = F.lower(F.try_element_at(kept, F.lit(-1)))
    return F.when(last.isin(*INDEX_FILES), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))).otherwise(kept)


def _query(url: Column) -> Column:
    pairs = F.filter(F.split(F.regexp_replace(_part(url, 4), r"^\?", ""), "&"), lambda p: p != "")
    parted = F.transform(pairs, lambda p: F.struct(
        F.lower(F.substring_index(p, "=", 1)).alias("k"),
        F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("").alias("v")))

    def counts(p: Column) -> Column:
        known = p["k"].isin(*TRACKING_KEYS, *SESSION_KEYS)
        for prefix in TRACKING_PREFIXES:
            known = known | p["k"].startswith(prefix)
        return (p["k"] != "") & ~known

    shown = F.transform(F.array_sort(F.filter(parted, counts)), lambda p: F.when(p["v"] == "", p["k"]).otherwise(F.concat(p["k"], F.lit("="), p["v"])))
    return F.array_join(shown, "&")


def canonical_key(url: Column) -> Column:
    """The key that spellings of one page share; null for what is no URL.

    Schemes other than http and https keep the host only.
    """
    scheme = F.lower(F.trim(_part(url, 1)))
    bare = F.regexp_replace(F.regexp_replace(host(url), HOST_PREFIX, ""), r"\.+$", "")
    path = F.array_join(F.transform(_resolved(_path(url)), lambda s: F.concat(F.lit("/"), s)), "")
    query = _query(url)
    page = F.concat(F.lit("http://"), bare, _port(url), path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    key = F.when(scheme.isin("http", "https"), page).otherwise(F.concat(scheme, F.lit("://"), host(url)))
    return F.when(_is_url(url), key)


def url_class(url: Column) -> Column:
    """image, media, archive, binary_document or page, by the last segment's extension."""
    last = F.element_at(F.split(_path(url), "/"), -1)
    ext = F.when(last.contains("."), F.lower(F.substring_index(last, ".", -1)))
    found = (F.when(ext.isin(*IMAGES), "image").when(ext.isin(*MEDIA), "media").when(ext.isin(*ARCHIVES), "archive")
             .when(ext.isin(*BINARY_DOCUMENTS), "binary_document"))
    return F.coalesce(F.when(_is_url(url), found), F.lit("page"))


def is_asset(kind: Column) -> Column:
    return kind.isin("image", "media", "archive")


def path_depth(url: Column) -> Column:
    return F.when(_is_url(url), F.size(_segments(_path(url)))).otherwise(0)


def has_query(url: Column) -> Column:
    return F.coalesce(_is_url(url) & (_part(url, 4) != ""), F.lit(False))


def archive_edition_of(url: Column) -> Column:
    """The live page's key, if a segment ``archive(s)`` precedes one with a digit and a page."""
    segments = _segments(_path(url))
    at = F.array_position(F.transform(segments, lambda s: s.isin("archive", "archives")), True)
    edition = F.try_element_at(segments, F.when(at > 0, at.cast("int") + 1))
    live = F.slice(segments, at.cast("int") + 2, F.size(segments))
    rebuilt = F.concat(_part(url, 1), F.lit("://"), host(url), F.lit("/"), F.array_join(live, "/"))
    found = _is_url(url) & (at > 0) & edition.rlike("[0-9]") & (F.size(segments) >= at + 2)
    return F.when(found, canonical_key(rebuilt))
