"""Fixed values of scans and the limits that hold among them."""

from __future__ import annotations

from dataclasses import dataclass

# Rungs of the scan strategy, the last one sticky.
LADDER = ("playwright_desktop", "playwright_mobile_first", "playwright_then_screenshotone", "screenshotone_only", "screenshotone_residential", "unreachable")
#: Failures in a row that promote to the next rung.
PROMOTE_AFTER = 2
# The heartbeat's least interval, re-reads of a late payload and their distance, times to live of caches, sizes of write buffers.
HEARTBEAT_SECONDS = 10
GRACE_READS, GRACE_SECONDS = 5, 1.5
CACHE_SECONDS = (30, 60, 1800)
BUFFERED_MATCHES, BUFFERED_IMAGES, BUFFERED_UPDATES = 50, 25, 100


@dataclass(frozen=True)
class Timeouts:
    """When a silent job counts as dead, and how long it may work. A job that works may be silent up to its cap, so the first must be the larger."""

    idle_minutes: float = 30
    cap_minutes: float = 25
    pending_minutes: float = 15

    def __post_init__(self) -> None:
        if self.idle_minutes <= self.cap_minutes:
            raise ValueError(f"jobs count as idle after {self.idle_minutes:g} minutes, which must be over their cap of {self.cap_minutes:g}")
