"""Web pages as a source: fetched on the executors, a request a URL."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.error import HTTPError
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame

AGENT, TIMEOUT = "quernstone/1.0", 30


def get(url: str) -> str:
    """The page's text; RuntimeError for a status other than 200."""
    try:
        with urlopen(Request(url, headers={"User-Agent": AGENT}), timeout=TIMEOUT) as answer:
            if answer.status != 200:
                raise RuntimeError(f"HTTP {answer.status}: {answer.status} {answer.reason}")
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except HTTPError as e:
        raise RuntimeError(f"HTTP {e.code}: {e.code} {e.reason}") from e


def fetch_pages(urls: DataFrame, fetch: Callable[[str], str] = get, parallel: int = 8) -> DataFrame:
    """(url, html, error) of urls (url): a failure becomes the row's error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            html, error = [], []
            for url in pdf.url:
                try:
                    html.append(fetch(url))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  whatever a site does, the other rows go on
                    html.append(None)
                    error.append(str(e))
            yield pd.DataFrame({"url": pdf.url, "html": html, "error": error})

    return urls.select("url").repartition(parallel).mapInPandas(run, "url string, html string, error string")
