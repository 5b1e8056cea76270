"""Scans over texts, URLs, markup and JSON."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def url_allowed(url: Column, hosts: Sequence[str], secure: bool = True) -> Column:
    """https, and a host of the list or below one."""
    host = url_host(url)
    ok = F.lit(False)
    for h in hosts:
        ok = ok | (host == h) | host.endswith(f".{h}")
    return F.coalesce(ok & (url.startswith("https://") if secure else F.lit(True)), F.lit(False))


def visible_text(html: Column) -> Column:
    """Text of markup without scripts, styles, comments and tags; blanks collapsed."""
    out = html
    for pattern in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->", r"(?s)<[^>]*>"):
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(out, r"[ \t\r\n]+", " "))


def near_each_other(text: Column, a: str, b: str, within: int = 240) -> Column:
    """Patterns ``a`` and ``b`` occur with at most ``within`` characters between them, in either order."""
    gap = rf"[\s\S]{{0,{within}}}"
    return F.coalesce(text.rlike(f"{a}{gap}{b}") | text.rlike(f"{b}{gap}{a}"), F.lit(False))


def ascii_bounds(pattern: str) -> str:
    r"""``pattern`` with each ``\b`` as a boundary of ASCII words, whatever letters the runtime's own ``\b`` counts."""
    return re.sub(r"\\(.)", lambda m: r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))" if m[1] == "b" else m[0], pattern, flags=re.DOTALL)


def forbidden_keys(json: Column, keys: Sequence[str]) -> Column:
    """Keys of the list that occur as keys anywhere in a JSON text, sorted."""
    found = F.regexp_extract_all(json, F.lit(r'"((?:[^"\\]|\\.)*)"\s*:'), 1)
    return F.array_sort(F.array_intersect(F.array_distinct(found), F.array(*map(F.lit, keys))))


def search_score(query: Column, name: Column) -> Column:
    """How well a name answers a query (both plain): 100 equal, 80 less the difference in length for a prefix either way,
    60 contained either way, else the best of 40 and 8 for each common word of over two letters, and 50 less 10 for
    each of up to two edits."""
    shared = F.size(F.filter(F.array_intersect(F.split(query, " "), F.split(name, " ")), lambda w: F.length(w) > 2))
    edits = F.levenshtein(query, name, 2)
    typo = F.when((F.length(query) >= 4) & (F.length(name) >= 4) & (edits >= 0), 50 - edits * 10).otherwise(0)
    return (
        F.when(query == name, 100)
        .when(name.startswith(query) | query.startswith(name), F.greatest(F.lit(0), 80 - F.abs(F.length(name) - F.length(query))))
        .when(name.contains(query) | query.contains(name), 60)
        .otherwise(F.greatest(F.when(shared > 0, 40 + shared * 8).otherwise(0), typo))
    )
