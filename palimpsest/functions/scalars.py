"""Column expressions for ids, paths, names, times and sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ID_PATTERN = "^[0-9a-f]{40}$"
STALE_MS = 7 * 60 * 1000
NAME_PUNCTUATION = r"""[~`!@#$%^&*()+=\[\]{}\\|;:'",<>/? ]"""


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a TIMESTAMP_NTZ, truncated."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), col(ts))


def whole_seconds(updated: Column | str) -> Column:
    """Milliseconds to seconds, truncated towards zero."""
    return ((col(updated) - col(updated) % 1000) / 1000).cast("bigint")


def file_id(path: Column | str, updated: Column | str) -> Column:
    """A version's id: SHA-1 of its path and whole second. Content is not part of it."""
    return F.sha1(F.concat(col(path), whole_seconds(updated).cast("string")))


def chunk_id(data: Column | str) -> Column:
    return F.sha1(col(data))


def basename(path: Column | str) -> Column:
    return F.substring_index(col(path), "/", -1)


def depth(path: Column | str) -> Column:
    """Number of slashes."""
    return F.length(col(path)) - F.length(F.replace(col(path), F.lit("/")))


def object_path(id: Column | str) -> Column:
    """Where an object lies: a folder of its first two digits."""
    return F.concat(F.substring(col(id), 1, 2), F.lit("/"), F.substring(col(id), 3, 1 << 20))


def object_id(path: Column | str) -> Column:
    return F.replace(col(path), F.lit("/"))


def rooted(path: Column | str, root: str = "") -> Column:
    """A path relative to `root`, with / separators and a leading one."""
    p = F.regexp_replace(col(path), r"\\", "/")
    if root:
        p = F.when(F.startswith(p, F.lit(root)), F.substring(p, len(root) + 1, 1 << 20)).otherwise(p)
    return F.concat(F.lit("/"), F.ltrim(p, F.lit("/")))


def valid_object_id(id: Column | str) -> Column:
    return F.coalesce(col(id).rlike(ID_PATTERN), F.lit(False))


def valid_repo_name(name: Column | str) -> Column:
    """1 to 63 bytes, without control characters and the punctuation that stores reject."""
    n = F.octet_length(col(name))
    return F.coalesce((n >= 1) & (n <= 63) & ~col(name).rlike(NAME_PUNCTUATION) & ~col(name).rlike(r"[\x00-\x1F\x7F-\x9F]"), F.lit(False))


def valid_tag_name(name: Column | str) -> Column:
    """Like a repository name, and neither dot name."""
    return valid_repo_name(name) & ~col(name).isin(".", "..")


def human_size(n: Column | str, units: tuple[str, ...] = ("kB", "MB", "GB", "TB")) -> Column:
    """Bytes in units of 1000 with one decimal from kB on; the last of `units` has no bound."""
    n = col(n)
    out = F.concat(n.cast("string"), F.lit(" B"))
    for k, unit in enumerate(units, 1):
        tenths = F.floor(n / (1000**k / 10)).cast("bigint")
        out = F.when(n >= 1000**k, F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))).otherwise(out)
    return out


def shown_time(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd HH:mm:ss")


def history_folder(ms: Column | str) -> Column:
    return F.concat(F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd-HHmmss"), F.lit("-sync"))
