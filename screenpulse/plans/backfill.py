"""Archived days that a history lacks, taken copy by copy.  It can stop at any point and go on later.

Two files remember the work: what became of each copy, and which copy each day led to.  A copy's outcome is final;
a day without one is asked about again until it is old enough to be settled.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date, timedelta
from pathlib import Path
from typing import TYPE_CHECKING

from ..config import HISTORY_START
from ..operators import gates
from ..sources import history, state, web

if TYPE_CHECKING:
    from .engine import Engine

#: Kept days between two lines of progress.
TELL_EVERY = 25


@dataclass
class Filled:
    added: list[date] = field(default_factory=list)
    skipped: list[str] = field(default_factory=list)
    stopped: str | None = None


class Ledger:
    """Outcomes by copy and copies by day, as JSON beside the copies."""

    def __init__(self, folder: Path, settled_before: date):
        folder.mkdir(parents=True, exist_ok=True)
        self._copies, self._days, self._settled_before = folder / "captures.json", folder / "probed.json", settled_before
        self.outcomes: dict[str, dict] = state.read_json(self._copies)
        self.led_to: dict[str, str | None] = state.read_json(self._days)

    def settled(self, day: date) -> bool:
        key = day.isoformat()
        return key in self.led_to and (self.led_to[key] is None or self.led_to[key] in self.outcomes)

    def rows_before(self, day: date) -> tuple[date, int] | None:
        """The last kept day before a day, and its rows."""
        kept = ((date.fromisoformat(x["day"]), x["rows"]) for x in self.outcomes.values() if x["status"] == "kept")
        return max((x for x in kept if x[0] < day), default=None)

    def save(self) -> None:
        state.write_json(self._copies, self.outcomes)
        state.write_json(self._days, {d: s for d, s in self.led_to.items() if date.fromisoformat(d) < self._settled_before})


class Backfill:
    def __init__(self, engine: Engine, *, until: date, since: date = HISTORY_START, http: web.Http = web.urllib_http, say: Callable[[str], None] = print, sleep: web.Sleep = time.sleep, pause: float = web.ARCHIVE_PAUSE):
        self.engine, self.since, self.until, self.say, self.pause = engine, since, until, say, pause
        self.sleep = sleep
        self.archive = web.Archive(http, self._wait, pause)
        self.ledger = Ledger(engine.archive, until - timedelta(days=engine.t.settle_days))
        self.held = history.known_days(engine.history)

    def _wait(self, seconds: float) -> None:
        if seconds >= 60:
            self.say(f"The archive asked us to slow down; waiting {seconds / 60:.0f} min.")
        self.sleep(seconds)

    def candidates(self) -> Iterator[str]:
        """Copies to look at: those the archive lists, or else those nearest to the days that are open."""
        try:
            yield from self.archive.captures(self.since)
            return
        except web.WebError:
            self.say("The archive's capture list is unavailable; checking day by day instead.")
        calendar = (self.since + timedelta(days=n) for n in range((self.until - self.since).days + 1))
        for day, stamp in self.archive.nearest_each(d for d in calendar if d not in self.held and not self.ledger.settled(d)):
            self.ledger.led_to[day.isoformat()] = stamp
            if stamp:
                yield stamp

    def outcome(self, stamp: str) -> dict:
        """What becomes of a copy: kept, duplicate or failed."""
        with self.archive.copied(stamp, self.engine.archive) as (path, day):
            if day in self.held:
                return {"status": "duplicate", "day": day.isoformat()}
            reason = "no Last-Modified date from IMDb" if day is None else "; ".join(f.message for f in gates.blocking(self.engine.check_file(web.RATINGS, path)))
            if reason:
                return {"status": "failed", "reason": reason}
            rows = self.engine.save_day(path, day)
        if before := self.ledger.rows_before(day):
            drift = gates.Drift(before[1], rows, (day - before[0]).days, self.engine.t.row_tolerance)
            if drift.too_far(self.engine.t):
                self.engine.history.remove(f"days/{day.isoformat()}")
                return {"status": "failed", "reason": f"in-scope rows moved {drift.share:+.1%} from {before[0]} ({drift.days} days earlier)"}
        self.held.add(day)
        return {"status": "kept", "day": day.isoformat(), "rows": rows}

    def run(self) -> Filled:
        out = Filled()
        try:
            for stamp in self.candidates():
                if stamp in self.ledger.outcomes:
                    continue
                self.ledger.outcomes[stamp] = got = self.outcome(stamp)
                self.ledger.save()
                if got["status"] == "failed":
                    out.skipped.append(f"copy {stamp}: {got['reason']}")
                if got["status"] == "kept":
                    out.added.append(date.fromisoformat(got["day"]))
                    if not len(out.added) % TELL_EVERY:
                        self.say(f"Archive: {len(out.added)} days added so far (latest {got['day']}).")
                self.sleep(self.pause)
        except web.WebError as error:
            out.stopped = str(error)
        finally:
            self.ledger.save()
            history.compact(self.engine.history)
        return out
