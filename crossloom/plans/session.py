"""Results held for paging: one computation per request, however many pages and callers ask for it."""

from __future__ import annotations

import threading
import time
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from crossloom.operators.aggregate import distinct_values
from crossloom.operators.drill import drill_down, limited
from crossloom.operators.paging import Page, page

from .engine import PivotFrames, pivot
from .errors import PivotError, SessionExpiredError
from .request import PivotRequest


@dataclass(frozen=True)
class Options:
    """Limits of a service; all must be positive."""

    sliding_seconds: float = 300
    least_source_rows: int = 1_000
    most_source_rows: int = 500_000
    default_source_rows: int = 100_000
    least_page: int = 10
    most_page: int = 200
    default_page: int = 40
    drill_limit: int = 1_000
    field_value_limit: int = 1_000
    excel_rows: int = 20_000
    excel_cells: int = 200_000

    def __post_init__(self) -> None:
        bad = [k for k, v in vars(self).items() if v <= 0]
        if bad or self.least_source_rows > self.most_source_rows or self.least_page > self.most_page:
            raise PivotError(f"options out of range: {', '.join(bad) or 'a least value is above its most'}")


class PageReader:
    """Pages of one request as lists of rows: offsets snap to page borders, the last few pages stay at hand,
    and a session that has expired is started again once."""

    def __init__(self, service: PivotService, request: PivotRequest, size: int = 40, keep: int = 6) -> None:
        self.service, self.request, self.size, self.keep = service, request, size, max(2, keep)
        self.pages: OrderedDict[int, list] = OrderedDict()
        self.session = service.start(request, page_size=size)[0]

    def rows(self, offset: int) -> list:
        at = offset // self.size * self.size
        if at not in self.pages:
            try:
                got = self.service.page(self.session, at, self.size)
            except SessionExpiredError:
                self.pages.clear()
                self.session = self.service.start(self.request, page_size=self.size)[0]
                got = self.service.page(self.session, at, self.size)
            self.pages[at] = got.rows.join(got.row_totals, "row_index").orderBy("row_index").collect()
            if len(self.pages) > self.keep:
                self.pages.popitem(last=False)
        self.pages.move_to_end(at)
        return self.pages[at]


@dataclass
class _Held:
    frames: PivotFrames
    total_rows: int
    seen: float


@dataclass
class PivotService:
    """Queries over one provider: a callable (spark, row hint or None) -> DataFrame.

    Sessions are told apart by request, hint, user and culture. They expire after sliding_seconds without a
    page, and their frames are released then. A computation that fails is not held."""

    spark: SparkSession
    provider: Callable[[SparkSession, int | None], DataFrame]
    options: Options = field(default_factory=Options)
    order_by: list[str] | None = None
    locale: str = ""
    user: str = ""
    clock: Callable[[], float] = time.monotonic

    def __post_init__(self) -> None:
        self._held: dict[str, _Held] = {}
        self._locks: dict[str, threading.Lock] = {}
        self._guard = threading.Lock()

    def source(self, hint: int | None = None) -> DataFrame:
        return self.provider(self.spark, hint)

    def run(self, request: PivotRequest) -> PivotFrames:
        return pivot(self.source(), request, order_by=self.order_by, locale=self.locale)

    def start(self, request: PivotRequest, *, hint: int | None = None, page_size: int | None = None) -> tuple[str, Page, bool]:
        """(session id, first page, whether the session was there already)."""
        o = self.options
        hint = min(max(hint or o.default_source_rows, o.least_source_rows), o.most_source_rows)
        size = min(max(page_size or o.default_page, o.least_page), o.most_page)
        key = request.identity(hint, self.user, self.locale, self.order_by)
        with self._guard:
            lock = self._locks.setdefault(key, threading.Lock())
        with lock:
            self._expire()
            there = key in self._held
            if not there:
                frames = pivot(self.source(hint), request, order_by=self.order_by, locale=self.locale)
                self._held[key] = _Held(frames, frames.rows.count(), self.clock())
            return key, self.page(key, 0, size), there

    def page(self, session: str, offset: int, size: int) -> Page:
        self._expire()
        held = self._held.get(session)
        if held is None:
            raise SessionExpiredError("the session has expired; start it again")
        held.seen = self.clock()
        return page(held.frames, offset, size, held.total_rows)

    def _expire(self) -> None:
        with self._guard:
            for key in [k for k, h in self._held.items() if self.clock() - h.seen > self.options.sliding_seconds]:
                self._held.pop(key).frames.release()

    def drill(self, request: PivotRequest, row_path=(), column_path=()) -> tuple[DataFrame, int, bool]:
        return limited(drill_down(self.source(), request, row_path, column_path, self.order_by), self.options.drill_limit)

    def field_values(self, name: str) -> DataFrame:
        """Labels of a field whatever filters are set, up to the limit, with the number of all."""
        return distinct_values(self.source(), name, self.locale, self.options.field_value_limit)

    def cancellable(self, group: str, work: Callable[[], object]) -> object:
        """Runs work under a job group that cancel() can stop."""
        self.spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
        return work()

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)
