"""URLs: parts, canonical form, hosts within domains."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query keys that only track.
TRACKING = ("fbclid", "gclid", "utm_campaign", "utm_content", "utm_medium", "utm_source", "utm_term", "jsessionid", "phpsessid")


def part(url: Column, name: str) -> Column:
    """scheme, host, path or query of an http(s) URL; empty if it has none, null if it is no such URL."""
    group = {"scheme": 1, "host": 2, "path": 4, "query": 5}[name]
    pattern = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#:@]+)(:[0-9]+)?([^?#]*)[?]?([^#]*)"
    return F.when(url.rlike("^[hH][tT][tT][pP][sS]?://[^/?#@]+([/?#]|$)"), F.regexp_extract(url, pattern, group))


def canonical(url: Column) -> Column:
    """Lower scheme and host, no default port, no fragment, no tracking keys, query sorted, no slash at the end; null if too long or not http(s)."""
    scheme, host, path = F.lower(part(url, "scheme")), F.lower(part(url, "host")), part(url, "path")
    port = F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#:]+:([0-9]+)", 1)
    shown = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    pairs = F.filter(F.split(part(url, "query"), "&", -1), lambda p: (p != "") & ~F.lower(F.split(p, "=", 2)[0]).isin(*TRACKING))
    query = F.array_join(F.array_sort(pairs), "&")
    whole = F.concat(scheme, F.lit("://"), host, shown, F.regexp_replace(path, "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(F.length(url) <= 4096, whole)


def within(host: Column, domain: Column) -> Column:
    """Whether a host is the domain or one of its subdomains."""
    return (F.lower(host) == F.lower(domain)) | F.endswith(F.lower(host), F.concat(F.lit("."), F.lower(domain)))
