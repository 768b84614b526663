"""Fetching from a slow public service: spacing, retries, waiting as told. For ingest jobs that
run ahead of the engine; the transport and the clock are given, so nothing here needs a network."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone
from email.utils import parsedate_to_datetime

# Answers worth another try, and how long to wait.
RETRYABLE = {408, 429, 500, 502, 503, 504}
RETRIES, FIRST_DELAY, LONGEST_DELAY, SPACING, MAXLAG = 5, 5.0, 30.0, 0.35, 5


@dataclass(frozen=True)
class Answer:
    status: int
    body: str = ""
    headers: dict = field(default_factory=dict)


def told_delay(value: str | None, now: datetime) -> float | None:
    """Seconds that a Retry-After header asks for: a number, or a date; null if it is neither."""
    value = (value or "").strip()
    try:
        return max(0.0, float(value)) if value and float(value) >= 0 else None
    except ValueError:
        pass
    try:
        at = parsedate_to_datetime(value)
    except (TypeError, ValueError):
        return None
    return max(0.0, ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - now).total_seconds())


def backoff(failures: int, retry_after: str | None, now: datetime, first: float = FIRST_DELAY) -> float:
    """What to wait after so many failures (0: the first): what the service asks for, else twice
    as long each time, up to a limit."""
    asked = told_delay(retry_after, now)
    return asked if asked is not None else min(LONGEST_DELAY, max(0.0, first) * 2**failures)


def is_lagging(body: str) -> bool:
    """The service's databases lag behind: an error inside an answer that is otherwise fine."""
    try:
        found = json.loads(body)
    except ValueError:
        return False
    return isinstance(found, dict) and (found.get("error") or {}).get("code") == "maxlag"


class Fetcher:
    """Serial requests, SPACING seconds apart; failures are tried again RETRIES times."""

    def __init__(self, get: Callable[[str], Answer], sleep: Callable[[float], None], now: Callable[[], datetime], cached: Callable[[str], str | None] | None = None, retries: int = RETRIES, spacing: float = SPACING):
        self.get, self.sleep, self.now, self.cached, self.retries, self.spacing = get, sleep, now, cached, retries, spacing
        self.last: datetime | None = None
        self.misses = 0

    def _wait_for_slot(self) -> None:
        if self.last is not None:
            left = self.spacing - (self.now() - self.last).total_seconds()
            if left > 0:
                self.sleep(left)
        self.last = self.now()

    def fetch(self, url: str) -> str:
        """The body of a URL: from the cache, or from the service."""
        body = self.cached(url) if self.cached else None
        if body is not None:
            return body
        self.misses += 1
        for failures in range(self.retries + 1):
            self._wait_for_slot()
            why, retry_after, again = "", None, True
            try:
                answer = self.get(url)
            except OSError as e:
                why = str(e)
            else:
                retry_after = {k.lower(): v for k, v in answer.headers.items()}.get("retry-after")
                if 200 <= answer.status < 300:
                    if not is_lagging(answer.body):
                        return answer.body
                    why = "maxlag"
                else:
                    why, again = f"status {answer.status}", answer.status in RETRYABLE
            if not again or failures == self.retries:
                break
            self.sleep(backoff(failures, retry_after, self.now()))
        raise RuntimeError(f"{url}: {why}")
