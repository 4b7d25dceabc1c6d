"""Links between pages: references taken from HTML and resolved against the page's address (RFC 3986), by column functions.

Defined cases: null html has no links; a page without an absolute address resolves only absolute references; references of
other schemes than http and https lead nowhere; an address is compared without its fragment, scheme and host in lower case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HREF = r"""(?is)<a\s(?:[^<>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
#: The expression of RFC 3986, appendix B.
_PARTS = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def hrefs(pages: DataFrame) -> DataFrame:
    """(page_id, url, ord, href) of every anchor, quotes off, white space trimmed, &amp; decoded."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_HREF), 1)
    raw = pages.select("page_id", "url", F.posexplode(found).alias("ord", "href"))
    text = F.regexp_replace("href", r"""^["']|["']$""", "")
    return raw.withColumn("href", F.regexp_replace(F.trim(F.regexp_replace(text, r"[\t\r\n]", "")), "(?i)&amp;", "&"))


def _part(c: Column, n: int) -> Column:
    return F.regexp_extract(c, _PARTS, n)


def without_dots(path: Column) -> Column:
    """path without its segments . and .. (RFC 3986, 5.2.4); .. never leaves the root."""
    parts = F.split(path, "/")
    kept = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda done, s: F.when(s == ".", done).when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).otherwise(F.array_append(done, s)),
    )
    open_ = F.element_at(parts, -1).isin(".", "..")
    return F.array_join(F.when(open_, F.array_append(kept, F.lit(""))).otherwise(kept), "/")


def resolved(base: Column, ref: Column) -> Column:
    """The address, without fragment, that ref stands for on a page at base; null where that isn't http or https."""
    scheme = F.when(_part(ref, 1) != "", _part(ref, 2)).otherwise(_part(base, 2))
    own = (_part(ref, 1) != "") | (_part(ref, 3) != "")
    host = F.when(own, _part(ref, 4)).otherwise(_part(base, 4))
    path, old = _part(ref, 5), _part(base, 5)
    beside = F.concat(F.coalesce(F.nullif(F.regexp_extract(old, r"^.*/", 0), F.lit("")), F.lit("/")), path)
    joined = F.when(own | path.startswith("/"), without_dots(path)).when(path == "", old).otherwise(without_dots(beside))
    query = F.when(own | (path != "") | (_part(ref, 6) != ""), _part(ref, 6)).otherwise(_part(base, 6))
    whole = F.concat(F.lower(scheme), F.lit("://"), F.lower(host), F.when(joined == "", "/").otherwise(joined), query)
    return F.when(F.lower(scheme).isin("http", "https") & (host != ""), whole)


def page_links(pages: DataFrame) -> DataFrame:
    """(page_id, source, target): the page's own address and each address that it links to, once."""
    base = F.coalesce("url", F.lit(""))
    out = hrefs(pages).select("page_id", resolved(base, F.lit("")).alias("source"), resolved(base, F.col("href")).alias("target"))
    return out.where(F.col("target").isNotNull()).distinct()
