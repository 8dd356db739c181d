"""Rules of the paged web sources: what to ask for, how to go on, when to try again.

Nothing here opens a connection; a reader calls these and appends whole runs.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import UTC, datetime, time, timedelta
from zoneinfo import ZoneInfo

# Fixed values of the sources.
BAR_SETTINGS = {"timeframe": "1Day", "adjustment": "split", "feed": "sip", "currency": "USD", "sort": "asc"}
RETRYABLE = {"market": {408, 429, 500, 502, 503, 504}, "filings": {429, 500, 502, 503, 504}}
MOST_PAGES, MOST_LOOKBACK = 100, 31
MARKET = ZoneInfo("America/New_York")


def _aware(value: datetime) -> datetime:
    if value.tzinfo is None:
        raise ValueError("a time needs an offset")
    return value.astimezone(UTC)


def bar_request(symbols: list[str], start: datetime, end: datetime, *, page_token: str | None = None, limit: int = 10_000) -> dict[str, str]:
    if not symbols or len(set(symbols)) != len(symbols) or not 1 <= limit <= 10_000:
        raise ValueError("symbols are unique and a page holds 1 to 10000 rows")
    asked = {"symbols": ",".join(symbols), "start": _aware(start).isoformat(), "end": _aware(end).isoformat(), "limit": str(limit), **BAR_SETTINGS}
    return asked | ({"page_token": page_token} if page_token else {})


def news_request(symbols: list[str], start: datetime, end: datetime, *, page_token: str | None = None, limit: int = 50) -> dict[str, str]:
    if not symbols or not 1 <= limit <= 50:
        raise ValueError("a page holds 1 to 50 articles")
    asked = {"symbols": ",".join(symbols), "start": _aware(start).isoformat(), "end": _aware(end).isoformat(), "limit": str(limit), "include_content": "true", "sort": "asc"}
    return asked | ({"page_token": page_token} if page_token else {})


@dataclass(frozen=True)
class Cursor:
    """Where a paged read stands; ``done`` once a page names no successor."""

    page: int = 1
    token: str | None = None
    seen: frozenset[str] = frozenset()
    done: bool = False

    def advance(self, token: str | None, most_pages: int = MOST_PAGES) -> Cursor:
        if token is None:
            return replace(self, done=True)
        if not token.strip() or token in self.seen or self.page >= most_pages:
            raise ValueError("the page token is blank or repeated, or there are too many pages")
        return Cursor(self.page + 1, token, self.seen | {token})


def bar_window(mode: str, *, start: datetime | None = None, end: datetime | None = None, lookback_days: int = 7, now: datetime | None = None) -> tuple[datetime, datetime]:
    """Backfill: the given bounds. Incremental: whole market days up to yesterday."""
    if mode == "backfill":
        if start is None or end is None or not _aware(start) < _aware(end):
            raise ValueError("a backfill needs start before end")
        return _aware(start), _aware(end)
    _incremental(mode, start, end, lookback_days)
    yesterday = (now or datetime.now(UTC)).astimezone(MARKET).date() - timedelta(days=1)
    first = yesterday - timedelta(days=lookback_days - 1)
    return datetime.combine(first, time(0), MARKET).astimezone(UTC), datetime.combine(yesterday, time(23, 59, 59), MARKET).astimezone(UTC)


def news_window(mode: str, *, start: datetime | None = None, end: datetime | None = None, lookback_days: int = 7, now: datetime | None = None) -> tuple[datetime, datetime]:
    """Backfill: the given bounds. Incremental: the days up to a quarter of an hour ago."""
    if mode == "backfill":
        return bar_window(mode, start=start, end=end)
    _incremental(mode, start, end, lookback_days)
    until = _aware(now or datetime.now(UTC)) - timedelta(minutes=15)
    return until - timedelta(days=lookback_days), until


def _incremental(mode, start, end, lookback_days) -> None:
    if mode != "incremental" or start is not None or end is not None or not 1 <= lookback_days <= MOST_LOOKBACK:
        raise ValueError("an incremental read has no bounds and looks back 1 to 31 days")


def retry_delay(attempt: int, retry_after: float | None = None, *, base: float = 1.0, most: float = 30.0) -> float:
    """Seconds before the next attempt: doubled each time, at least what the server asks, at most ``most``."""
    if attempt < 1:
        raise ValueError("attempts count from 1")
    return min(most, max(base * 2 ** (attempt - 1), retry_after or 0.0))


def spacing_delay(elapsed: float, least: float = 0.2) -> float:
    return max(0.0, least - max(0.0, elapsed))


def submissions_path(cik: str) -> str:
    return f"/submissions/CIK{cik:0>10}.json"


def facts_path(cik: str) -> str:
    return f"/api/xbrl/companyfacts/CIK{cik:0>10}.json"


def filing_path(cik: str, accession: str, document: str) -> str:
    if "/" in document or not document:
        raise ValueError("a document name is no path")
    return f"/Archives/edgar/data/{int(cik)}/{accession.replace('-', '')}/{document}"
