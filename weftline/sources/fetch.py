"""The web as a source: an optional plug-in that fetches urls in Arrow batches. The engine itself never opens a
connection; a fetcher is given by the caller."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_BYTES = 100_000
FETCHED = "url string, response_code int, content_type string, page binary, length bigint, location string"
REDIRECTS = (301, 302, 303, 307, 308)

#: (status, content type, body) of a url; None if it can't be had.
Fetcher = Callable[[str], "tuple[int, str, bytes] | None"]
#: (status, content type, content language, location) of a url without its body; None if it can't be had.
Header = Callable[[str], "tuple[int, str | None, str | None, str | None] | None"]


def _is_html(kind: str | None) -> bool:
    return (kind or "").lower().split(";")[0].strip() in ("text/html", "application/xhtml+xml")


def fetch(urls: DataFrame, fetcher: Fetcher, max_bytes: int = MAX_BYTES, head: Header | None = None, language: str | None = "en") -> DataFrame:
    """A row for each row of ``urls`` with a url: HTML pages of status 200 cut to ``max_bytes``, others without a page;
    a fetcher that fails or gives None leaves all but the url null. A task that runs again fetches again.

    ``head`` is asked first, if given: what is redirected (then ``location`` is where to, in absolute form, a new url for
    the frontier), is no HTML of status 200 or names another content language than ``language`` is not fetched."""

    def one(u: str) -> tuple:
        if head is not None:
            got = head(u)
            if got is None:
                return u, None, None, None, None, None
            status, kind, lang, location = got
            if status in REDIRECTS:
                return u, status, kind, None, None, urljoin(u, location) if location else None
            if status != 200 or not _is_html(kind) or (language and lang and not lang.lower().startswith(language)):
                return u, status, kind, None, None, None
        got = fetcher(u)
        status, kind, body = got if got else (None, None, None)
        page = body[:max_bytes] if status == 200 and body is not None and _is_html(kind) else None
        return u, status, kind, page, len(body) if body is not None else None, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["url", "response_code", "content_type", "page", "length", "location"]
        types = [pa.string(), pa.int32(), pa.string(), pa.binary(), pa.int64(), pa.string()]
        for b in batches:
            rows = []
            for u in b.column(0).to_pylist():
                if u is None:
                    continue
                try:
                    rows.append(one(u))
                except Exception:  # noqa: BLE001 - a page that can't be fetched is a row without a page
                    rows.append((u, None, None, None, None, None))
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return urls.select("url").mapInArrow(run, FETCHED)
