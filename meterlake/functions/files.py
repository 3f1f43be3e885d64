"""Path / URL / object-key column functions (M1-M4), regex based, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterlake import dims

# scheme://netloc prefix, then everything up to the first '?' or '#'.
_SCHEME_NETLOC = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*"


def url_path(url) -> Column:
    """Path part of a URL or local path: drop scheme and host, query and fragment.
    (``substring_index`` rather than end-anchored regexes: linear in the length.)"""
    u = _c(url)
    rest = F.when(F.instr(u, "://") > 0, F.regexp_replace(u, _SCHEME_NETLOC, "")).otherwise(u)
    return F.substring_index(F.substring_index(rest, "?", 1), "#", 1)


def base_name(url) -> Column:
    """Last path component, without ``;params``."""
    return F.substring_index(F.substring_index(url_path(url), "/", -1), ";", 1)


def split_ext(name) -> Column:
    """Extension with its dot, in original case; leading dots never start an
    extension ('.bashrc' has none, 'a.tar.gz' gives '.gz', 'a.' gives '.')."""
    stem = F.ltrim(_c(name), F.lit("."))
    return F.when(F.instr(stem, ".") > 0, F.concat(F.lit("."), F.substring_index(stem, ".", -1))).otherwise(F.lit(""))


def file_category(url) -> Column:
    """image / video / audio / document / default by lower-cased extension."""
    ext = F.lower(F.substring(split_ext(base_name(url)), 2, 1 << 20))
    out = F.lit("default")
    for cat in reversed(list(dims.FILE_TYPES)):
        out = F.when(ext.isin(*dims.FILE_TYPES[cat]), F.lit(cat)).otherwise(out)
    return out


def file_extension(url) -> Column:
    return split_ext(base_name(url))


def is_remote(url) -> Column:
    u = _c(url)
    return u.startswith("http://") | u.startswith("https://")


def key_invalid_reason(key) -> Column:
    """First failing object-key rule, or NULL for a valid key."""
    k = _c(key)
    return (F.when(k.isNull() | k.rlike(r"^\s*$"), F.lit("empty"))
            .when(F.octet_length(k) > dims.KEY_MAX_BYTES, F.lit("too_long"))
            .when(k.startswith("/") | k.endswith("/"), F.lit("slash_edge"))
            .when(F.instr(k, "//") > 0, F.lit("double_slash"))
            .when(~k.rlike(dims.KEY_ALLOWED_PATTERN), F.lit("bad_char"))
            .otherwise(F.lit(None)))


def key_bad_char(key) -> Column:
    """First character outside the allowed set ('' when none)."""
    return F.regexp_extract(_c(key), dims.KEY_BAD_CHAR_PATTERN, 0)


def _name_part(name) -> Column:
    """Final path component the way ``pathlib`` sees it: trailing slashes and
    ``.`` components are dropped first ('dir/.' -> 'dir', '.' -> '')."""
    last = F.substring_index(F.regexp_replace(_c(name), r"(/+\.?)+$", ""), "/", -1)
    return F.when(last == ".", F.lit("")).otherwise(last)


def name_suffix(name) -> Column:
    """Suffix of the last path component: from its last dot, if that dot is
    neither the first nor the last character."""
    return F.regexp_extract(_name_part(name), r"^.+(\.[^.]+)$", 1)


def name_stem(name) -> Column:
    last = _name_part(name)
    return last.substr(F.lit(1), F.length(last) - F.length(name_suffix(name)))


def unique_key(name) -> Column:
    """``stem_<8 hex>suffix``: deterministic (sha-256 of the name), so retries agree."""
    return F.concat(name_stem(name), F.lit("_"), F.substring(F.sha2(_c(name), 256), 1, 8),
                    F.lower(name_suffix(name)))


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c
