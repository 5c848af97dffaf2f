"""URL policy."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from groundspark.config import DEMO


def is_allowed_url(url: Column, domains: tuple[str, ...] = DEMO.allowed_domains) -> Column:
    """http(s) URLs whose host is an allowed domain or below one; user info and ports don't fool it, null is not allowed."""
    host = F.lower(F.try_parse_url(F.trim(url), F.lit("HOST")))
    scheme = F.lower(F.try_parse_url(F.trim(url), F.lit("PROTOCOL")))
    listed = F.lit(False)
    for d in domains:
        listed = listed | (host == d) | host.endswith("." + d)
    return F.coalesce(scheme.isin("http", "https") & listed, F.lit(False))
