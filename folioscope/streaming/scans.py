"""Incremental scans as a stateful stream: watermarks, stops and audits per account, kept in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from folioscope.streaming.incremental import DAY

#: What a stream of pages needs, and what comes out of it.
PAGES = "account string, page long, at array<long>, ids array<string>, seen_at timestamp"
RESULT = "account string, page long, oldest long, crossed boolean, stop boolean, reason string"
#: The state store that keeps it; the session must be set to it (spark.sql.streaming.stateStore.providerClass).
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Days until an account is read as a whole again (fixed value).
AUDIT_DAYS = 30
_NEVER = -1


class Scan(StatefulProcessor):
    """One account's scan: what is known, where the scan crossed it, and whether it has ended.

    A page 0 begins a scan. A page crosses if an article of it is older than the watermark, or of
    its second and known. The scan ends at the first page that is `required` pages or more behind the first
    crossing and reaches back to the overlap floor (`overlap`), at a page without articles
    (`complete`), or at the hard floor (`date-floor`). Only an ended scan moves the watermark; pages
    of an ended scan are dropped, a page that is not the next one is an error row (`not-advancing`)
    and changes nothing. `audit` days after a scan that ended, the account is due as a whole
    (`audit-due`).
    """

    def __init__(self, required: int, overlap_days: int, hard_floor: int, audit_days: int):
        self.required, self.overlap, self.floor, self.audit = required, overlap_days * DAY, hard_floor, audit_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", "watermark long, ids array<string>")
        self.scan = handle.getValueState("scan", "next long, first long, oldest long, newest long, ids array<string>, ended boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        watermark, known = self.known.get() if self.known.exists() else (0, [])
        scan = list(self.scan.get()) if self.scan.exists() else [0, _NEVER, _NEVER, 0, [], True]
        out = []
        pages = pd.concat(list(rows)).sort_values(["seen_at", "page"], kind="stable")
        for page, at, ids in zip(pages["page"], pages["at"], pages["ids"], strict=True):
            page, at, ids = int(page), [int(t) for t in at], [str(i) for i in ids]
            if page == 0 and scan[5]:
                scan = [0, _NEVER, _NEVER, 0, [], False]
            if scan[5]:
                continue
            if page != scan[0]:
                out.append((key[0], page, None, None, None, "not-advancing"))
                continue
            known_ids = set(known)
            crossed = watermark > 0 and any(t < watermark or (t == watermark and i in known_ids) for t, i in zip(at, ids, strict=True))
            first = page if crossed and scan[1] == _NEVER else scan[1]
            oldest = min([t for t in (*at, scan[2]) if t != _NEVER], default=_NEVER)
            newest = max([*at, scan[3]])
            held = [i for t, i in zip(at, ids, strict=True) if t == newest] + (scan[4] if newest == scan[3] else [])
            stop = first != _NEVER and page - first >= self.required and oldest <= max(self.floor, watermark - self.overlap)
            reason = "complete" if not at else "overlap" if stop else "date-floor" if min(at) < self.floor else None
            scan = [page + 1, first, oldest, newest, sorted(set(held)), reason is not None]
            out.append((key[0], page, min(at, default=None), crossed, reason is not None, reason))
            if reason is not None:
                if newest > watermark:
                    watermark, known = newest, scan[4]
                elif newest == watermark:
                    known = sorted({*known, *scan[4]})
                self.known.update((watermark, list(known)))
                for timer in self.handle.listTimers():
                    self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
                now = int(pd.Timestamp(pages["seen_at"].max()).timestamp() * 1000)
                self.handle.registerTimer(now + self.audit * DAY * 1000)
        self.scan.update(tuple(scan))
        yield self._rows(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows([(key[0], None, None, None, None, "audit-due")])

    def _rows(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["account", "page", "oldest", "crossed", "stop", "reason"])
        return out.astype({"page": "Int64", "oldest": "Int64", "crossed": "boolean", "stop": "boolean"})

    def close(self) -> None:
        pass


def scan_stream(pages: DataFrame, required: int = 1, overlap_days: int = 14, hard_floor: int = 0, audit_days: int = AUDIT_DAYS, lateness: str = "1 day") -> DataFrame:
    """The pages (see PAGES) that scans read, with why they end, and accounts that are due as a whole, as a stream of RESULT.

    State is one row of each kind an account, in the state store of the query's checkpoint: a query
    that is started again goes on where it was. seen_at is the event time; audits come due by it.
    """
    timed = pages.withWatermark("seen_at", lateness)
    return timed.groupBy("account").transformWithStateInPandas(Scan(required, overlap_days, hard_floor, audit_days), RESULT, "Append", "EventTime")
