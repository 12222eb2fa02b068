"""Column expressions over paths and note texts. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters stripped from both ends of a text (wider than SQL trim).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
ABSTRACT_CHARS = 500


def posix_path(path: Column) -> Column:
    """Drop empty and `.` components: `a//b/./c/` becomes `a/b/c`."""
    collapsed = F.regexp_replace(path, r"/+(\./+)*", "/")
    return F.regexp_replace(F.regexp_replace(collapsed, r"^(\./)+", ""), r"(?<=.)/\.?\z", "")


def normalise_path(path: Column) -> Column:
    """The stored form of a path: forward slashes only, no empty components."""
    return posix_path(F.translate(path, "\\", "/"))


def path_stem(path: Column) -> Column:
    """Last component without its last suffix; a leading dot starts no suffix."""
    name = F.regexp_extract(path, r"([^/]*)\z", 1)
    return F.regexp_replace(name, r"(?s)^(.+)\.[^.]+\z", "$1")


def fingerprint(text: Column) -> Column:
    """MD5 hex digest of the UTF-8 text."""
    return F.md5(F.encode(text, "UTF-8"))


def unix_newlines(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def strip_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(WHITESPACE))


def strip_both(text: Column) -> Column:
    return F.trim(text, F.lit(WHITESPACE))


def abstract(text: Column, chars: int = ABSTRACT_CHARS) -> Column:
    """The first characters of a text, as shown to a link decider."""
    return F.concat(F.substring(text, 1, chars), F.lit("..."))


def _any(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def path_not_ignored(path: Column, prefixes: Iterable[str]) -> Column:
    """True unless the path starts with one of the prefixes."""
    return ~_any(path.startswith(p) for p in prefixes)


def path_not_temporary(path: Column, suffixes: Iterable[str]) -> Column:
    """True unless the path ends like a temporary or swap file."""
    return ~_any(path.endswith(s) for s in suffixes)


def link_exists(content: Column, target: Column) -> Column:
    """True when the text holds `[[target]]` or `[[stem of target]]`."""
    return content.contains(F.concat(F.lit("[["), target, F.lit("]]"))) | content.contains(
        F.concat(F.lit("[["), path_stem(target), F.lit("]]"))
    )
