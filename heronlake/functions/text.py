"""Text functions: byte-bounded cuts, literal case-blind search, snippets, remotes, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTENT_BYTES = 256 * 1024


def truncate_bytes(text: Column, n: int) -> Column:
    """The longest prefix of at most n UTF-8 bytes that ends between characters."""
    raw = F.make_valid_utf8(text).cast("binary")
    # a cut before a byte that continues a character (10xxxxxx) goes back to that character's first byte, at most three
    inside = lambda at: F.substring(raw, at + 1, 1).between(F.unhex(F.lit("80")), F.unhex(F.lit("BF")))
    end = F.lit(max(0, n - 3))
    for at in range(max(0, n - 2), n + 1):
        end = F.when(~inside(at), F.lit(at)).otherwise(end)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.substring(raw, F.lit(1), end).cast("string"))


def holds(text: Column, query: str) -> Column:
    """Literal, case-blind containment."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def snippet(text: Column, query: str, around: int = 120) -> Column:
    """The first match with up to `around` characters on each side, cut sides marked, on one line."""
    at = F.locate(query.lower(), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    size = at - start + len(query) + around
    body = F.translate(F.substring(text, start, size), "\n\t\r", "   ")
    out = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + size - 1 < F.length(text), "…").otherwise(""))
    return F.when(at > 0, out)


def git_remote(remote: Column) -> Column:
    """A remote in one form: host/path in lower case, without scheme, user, port, `.git` or end slashes."""
    r = F.regexp_replace(F.rtrim(F.trim(remote), F.lit("/")), r"\.git$", "")
    r = F.regexp_replace(r, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:]+)(?::\d+)?", "$1")
    r = F.regexp_replace(r, r"^[^/@:]+@([^/:]+):", "$1/")
    return F.lower(F.rtrim(r, F.lit("/")))


def project_link(remote: Column, root_commit: Column) -> Column:
    """remote@root for a full root commit id, else the empty string."""
    return F.when((git_remote(remote) != "") & root_commit.rlike("^(?:[0-9a-f]{40}|[0-9a-f]{64})$"), F.concat(git_remote(remote), F.lit("@"), root_commit)).otherwise("")


def cwd_hash(cwd: Column) -> Column:
    return F.substring(F.sha2(cwd, 256), 1, 16)


def mcp_tool_name(server: Column, tool: Column) -> Column:
    """mcp__<server>__<tool>, with other characters than letters, digits, _ and - replaced."""
    clean = lambda c: F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")
    return F.concat(F.lit("mcp__"), clean(server), F.lit("__"), clean(tool))


def iec_bytes(n: Column) -> Column:
    """A size with one decimal in the largest unit that keeps it at 1 or more; a half goes to the even digit.

    Tenths are taken in whole numbers, as the engine's own %.1f rounds every half up.
    """
    n = n.cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        size = 1024**i
        rest = F.pmod(n, F.lit(size)) * 10
        down, over = F.shiftright(n, 10 * i) * 10 + F.shiftright(rest, 10 * i), F.pmod(rest, F.lit(size))
        tenths = down + F.when((over > size // 2) | ((over == size // 2) & (down % 2 == 1)), 1).otherwise(0)
        shown = F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(f" {unit}"))
        out = F.when(n >= size, shown).otherwise(out)
    return out


def short_count(n: Column) -> Column:
    """A count in at most one decimal of k, M or G."""
    out = n.cast("string")
    for i, unit in enumerate(("k", "M", "G"), 1):
        out = F.when(n >= 1000**i, F.concat(F.format_string("%.1f", F.floor(n.cast("double") * 10 / 1000**i) / 10), F.lit(unit))).otherwise(out)
    return out


def nice_ceil(n: Column) -> Column:
    """The smallest of 1, 2 or 5 times a power of ten that is not below n."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(n.cast("double"), F.lit(1.0)))))
    return F.when(n <= unit, unit).when(n <= 2 * unit, 2 * unit).when(n <= 5 * unit, 5 * unit).otherwise(10 * unit).cast("long")
