"""Loading of sources: allow-list, fetching behind an interface, parsing, checks; every source keeps its row."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundspark.config import DEFAULT, DEMO, EngineConfig, Profile
from groundspark.functions.urls import is_allowed_url
from groundspark.operators.html import decode_html, has_enough_text, html_parts, is_soft_404, kind

#: url -> (status, content type, body)
Fetch = Callable[[str], tuple[int, str, bytes]]
_RETRY = (429, 500, 502, 503, 504)


def http_fetch(url: str, timeout: float = DEFAULT.fetch_timeout) -> tuple[int, str, bytes]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "groundspark"}), timeout=timeout) as found:
            return found.status, found.headers.get("Content-Type", ""), found.read()
    except urllib.error.HTTPError as e:
        return e.code, e.headers.get("Content-Type", "") if e.headers else "", b""


def with_retries(fetch: Fetch, url: str, config: EngineConfig = DEFAULT, sleep: Callable[[float], None] = time.sleep) -> tuple[int, str, bytes]:
    """Again after 2, 4, ... seconds on busy answers and on transport errors."""
    for attempt in range(1, config.fetch_retries + 1):
        try:
            found = fetch(url)
            if found[0] not in _RETRY or attempt == config.fetch_retries:
                return found
        except OSError:
            if attempt == config.fetch_retries:
                raise
        sleep(config.fetch_backoff * attempt)
    raise ValueError("no attempts allowed")


def fetched(sources: DataFrame, fetch: Fetch = http_fetch, config: EngineConfig = DEFAULT, profile: Profile = DEMO) -> DataFrame:
    """Add http_status, content_type, content, fetch_seconds, error; only allowed URLs are requested."""
    schema = "url string, http_status int, content_type string, content binary, fetch_seconds double, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                began = time.monotonic()
                try:
                    status, content_type, body = with_retries(fetch, url, config)
                    rows.append((url, status, content_type, body, time.monotonic() - began, f"status {status}" if status >= 400 else None))
                except Exception as e:  # noqa: BLE001 - a source's failure is a row, not the run's end
                    rows.append((url, None, None, None, time.monotonic() - began, f"{type(e).__name__}: {e}"[:300]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    allowed = sources.filter(is_allowed_url(F.col("url"), profile.allowed_domains)).select("url").distinct()
    found = allowed.mapInPandas(run, schema)
    joined = sources.join(found, "url", "left")
    return joined.withColumn("error", F.when(~is_allowed_url(F.col("url"), profile.allowed_domains), "source not allowed").otherwise(F.col("error")))


def loaded(pages: DataFrame, config: EngineConfig = DEFAULT) -> DataFrame:
    """Parse fetched HTML rows: title, blocks, kind, text_chars, status ok or error with a reason."""
    parsed = pages.withColumn("kind", kind(F.col("content"), F.col("content_type"))).withColumn("parts", html_parts(decode_html("content")))
    parsed = parsed.withColumns({"title": F.col("parts.title"), "blocks": F.col("parts.blocks")}).drop("parts")
    reason = F.coalesce(F.col("error"), F.when(F.col("kind") == "pdf", "no PDF reader is installed"), F.when(is_soft_404(F.col("title"), F.col("blocks")), "the page says that it does not exist"), F.when(~has_enough_text(F.col("blocks"), config), "too little text"))
    return parsed.withColumns({"error": F.substring(reason, 1, 300), "text_chars": F.length(F.array_join("blocks", "\n\n"))}).withColumn("status", F.when(F.col("error").isNull(), "ok").otherwise("error"))


def manifest(loaded_pages: DataFrame) -> DataFrame:
    """The manifest's columns of loaded pages."""
    return loaded_pages.select(
        "url", "scheme", "doc_type", "kind", "http_status", F.length("content").cast("long").alias("bytes_downloaded"), "text_chars", F.lit(1).alias("pages"),
        "fetch_seconds", F.date_format(F.current_date(), "yyyy-MM-dd").alias("fetched_at"), F.lit("").alias("raw_file"), "status", F.coalesce("error", F.lit("")).alias("error"),
    )
