"""URLs: absolute or not, joining, hosts, which links a crawl follows."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Second-level labels under which names are registered, where the country's code follows.
SECOND_LEVEL = ["co", "com", "org", "net", "ac", "gov", "edu"]
STRATEGIES = ("all", "same-hostname", "same-domain", "same-origin")


def is_absolute(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("PROTOCOL")).isNotNull() & F.try_parse_url(url, F.lit("HOST")).isNotNull()


@F.pandas_udf(T.StringType())
def joined(base: pd.Series, url: pd.Series) -> pd.Series:
    """A link on a page as an absolute URL; NULL if it can't be one."""

    def join(b: str | None, u: str | None) -> str | None:
        if b is None or u is None:
            return None
        try:
            return urljoin(b, u)
        except ValueError:
            return None

    return pd.Series([join(b, u) for b, u in zip(base, url, strict=True)], dtype=object)


def absolute(base: Column, url: Column) -> Column:
    """Absolute URLs as they are; only the others are joined to the page's."""
    return F.when(is_absolute(url), url).otherwise(joined(base, url))


def is_irrelevant(url: Column) -> Column:
    return url.isNull() | (url == "") | url.rlike("^javascript:") | url.rlike("^#")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _port(url: Column) -> Column:
    """The port that is given, else the scheme's."""
    given = F.nullif(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*:(\d+)", 1), F.lit(""))
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    return F.coalesce(given, F.when(scheme == "https", "443").when(scheme == "http", "80"))


def domain_label(url: Column) -> Column:
    """The label under which a name is registered, without its suffix: a.example.co.uk gives example.

    Suffixes are one label, or one of the usual second-level labels with a country's code; there is no list of all.
    Only this label is compared for the same domain, so example.com and example.org are the same.
    """
    parts = F.split(host(url), r"\.")
    n = F.size(parts)
    double = (n >= 3) & (F.length(F.get(parts, n - 1)) == 2) & F.get(parts, n - 2).isin(SECOND_LEVEL)
    return F.when(n == 1, F.get(parts, F.lit(0))).when(double, F.get(parts, n - 3)).otherwise(F.get(parts, n - 2))


def follows(strategy: str, origin: Column, target: Column) -> Column:
    """Whether a crawl that started at ``origin`` goes on to ``target``. A URL without host isn't followed."""
    both = host(origin).isNotNull() & host(target).isNotNull()
    scheme = lambda u: F.lower(F.try_parse_url(u, F.lit("PROTOCOL")))
    if strategy == "all":
        return F.lit(True)
    if strategy == "same-hostname":
        test = host(origin) == host(target)
    elif strategy == "same-domain":
        test = domain_label(origin) == domain_label(target)
    elif strategy == "same-origin":
        test = (host(origin) == host(target)) & (scheme(origin) == scheme(target)) & _port(origin).eqNullSafe(_port(target))
    else:
        return F.lit(False)
    return F.coalesce(both & test, F.lit(False))


def has_keyword(url: Column, keywords: list[str]) -> Column:
    """Whether the URL without its scheme contains any of the words; true if there are none."""
    if not keywords:
        return F.lit(True)
    bare = F.regexp_replace(F.lower(url), r"^[a-z][a-z0-9+.-]*://", "")
    test = F.lit(False)
    for k in keywords:
        test = test | F.contains(bare, F.lit(k.lower()))
    return test
