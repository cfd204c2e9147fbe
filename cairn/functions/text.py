"""Text and path functions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space and line ends, for Java's regular expressions.
BLANK = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
RESERVED = ("init", "deinit", "update-index", "search", "insert", "remove", "list", "info", "chunk", "reset", "help", "version")


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANK}+|{BLANK}+$", "")


def count_lines(c: Column) -> Column:
    """Line ends, and one more if the last line has no end; 0 for an empty text."""
    ends = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(F.length(c) == 0, F.lit(0)).otherwise(ends + F.when(c.endswith("\n"), 0).otherwise(1)).cast("long")


def preview(c: Column, size: int = 200) -> Column:
    return F.substring(c, 1, size)


def rendered_preview(c: Column, size: int = 120) -> Column:
    return F.replace(F.substring(c, 1, size), F.lit("\n"), F.lit(" "))


def embed_input(c: Column, max_chars: int, prefix: str = "") -> Column:
    """Trimmed, null if blank, cut to ``max_chars``, then prefixed."""
    t = trim(c)
    return F.when(F.length(t) > 0, F.concat(F.lit(prefix), F.substring(t, 1, max_chars)))


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Without the dot, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(basename(path), r"[^.].*\.([^.]+)$|^\.[^.]+\.([^.]+)$", 1))


def size_unit(path: Column) -> Column:
    return F.when(extension(path) == "pdf", F.lit("P")).otherwise(F.lit("L"))


def relative_path(path: Column, root: str) -> Column:
    """Below ``root``: the rest; the root itself: empty; elsewhere: the file's name."""
    root = re.sub(r"/+$", "", root) or "/"
    clean = F.regexp_replace(F.regexp_replace(path, r"/(\./)+", "/"), r"(?<=.)/+$", "")
    inside = root if root == "/" else root + "/"
    return F.when(clean == root, F.lit("")).when(clean.startswith(inside), F.substring(clean, F.lit(len(inside) + 1), F.length(clean))).otherwise(basename(clean))


def is_under(path: Column, root: str) -> Column:
    return path.startswith(root.rstrip("/") + "/")


def glob_to_regex(pattern: str) -> str:
    """A shell pattern, anchored: ``*`` and ``?`` also meet ``/``, ``[!a-z]`` negates, a backslash takes the next character as it is."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append("(?s:.*)")
        elif c == "?":
            out.append("(?s:.)")
        elif c == "\\" and i < len(pattern):
            out.append(re.escape(pattern[i]))
            i += 1
        elif c == "[":
            j = i + (pattern[i : i + 1] in ("!", "^"))
            j += pattern[j : j + 1] == "]"
            while j < len(pattern) and pattern[j] != "]":
                j += 2 if pattern[j] == "\\" else 1
            if j >= len(pattern):
                out.append(r"\[")
            else:
                body = re.sub(r"([\[&~|^])", r"\\\1", pattern[i:j].lstrip("!^") if pattern[i] in "!^" else pattern[i:j])
                body = "\\]" + body[1:] if body.startswith("]") else body
                out.append(f"[{'^' if pattern[i] in '!^' else ''}{body}]")
                i = j + 1
        else:
            out.append(re.escape(c))
    return "^" + "".join(out) + "$"


def matches_glob(path: Column, pattern: str) -> Column:
    """The file's name against a pattern."""
    return basename(path).rlike(glob_to_regex(pattern))


def ignore_patterns(text: str) -> list[str]:
    return [s for line in text.splitlines() if (s := line.strip()) and not s.startswith("#")]


def is_ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path meets one of the patterns; there is no negation.

    ``/x`` at the root only; ``x/`` a folder anywhere, ``/x/`` at the root; others against the path or its name.
    """
    hit = F.lit(False)
    for p in patterns:
        if p.endswith("/"):
            folder = p.lstrip("/") if p.startswith("/") else p
            hit = hit | path.startswith(folder)
            if not p.startswith("/"):
                hit = hit | path.contains("/" + folder)
        elif p.startswith("/"):
            hit = hit | path.rlike(glob_to_regex(p[1:]))
        else:
            hit = hit | path.rlike(glob_to_regex(p)) | basename(path).rlike(glob_to_regex(p))
    return hit


def sanitized_name(c: Column) -> Column:
    """Letters, digits, ``-`` and ``_`` stay, all else becomes ``-``; runs of ``-`` are one, and none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}_-]", "-"), r"-+", "-"), r"^-|-$", "")


def valid_name(name: str) -> bool:
    return bool(name) and all(ch.isalnum() or ch in "-_" for ch in name) and name not in RESERVED


IDENTITY = r"^([a-z0-9-]+)@([1-9][0-9]*)/([0-9]+)$"


def parse_identity(c: Column) -> Column:
    """``alias@size/overlap`` as a struct, or null; numbers must be written without leading zeros and fit an int."""
    alias = F.regexp_extract(c, IDENTITY, 1)
    size, overlap = (F.regexp_extract(c, IDENTITY, i).try_cast("int") for i in (2, 3))
    fine = F.concat(alias, F.lit("@"), size.cast("string"), F.lit("/"), overlap.cast("string")) == c
    return F.when(c.rlike(IDENTITY) & fine, F.struct(alias.alias("alias"), size.alias("size"), overlap.alias("overlap")))


def seconds_text(c: Column, digits: int = 1) -> Column:
    return F.when(c >= 1, F.format_string(f"%.{digits}fs", c)).otherwise(F.format_string("%.0fms", c * 1000))


def bottleneck(save_queue: Column, extract_queue: Column, pool_busy: Column, workers: Column) -> Column:
    """Which stage holds the others up."""
    return F.when(save_queue > workers, "db").when(pool_busy >= workers, "embed").when((extract_queue > 0) & (pool_busy == 0), "extract").otherwise("ok")
