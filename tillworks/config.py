"""Run parameters.  All thresholds, clocks and parity switches travel in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from decimal import Decimal


@dataclass(frozen=True)
class Config:
    run_id: str = "manual"
    #: "today" for every relative window; a wall clock inside a query would make retries disagree.
    as_of: date = field(default_factory=date.today)
    #: one timestamp per run, stamped on every row, report and audit entry of that run.
    executed_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc).replace(tzinfo=None))
    job_name: str = "tillworks-load"
    version: str = "v1.0.0"
    created_by: str = "tillworks"

    pass_threshold: Decimal = Decimal("0.95")
    warn_threshold: Decimal = Decimal("0.70")
    anomaly_revenue_max: Decimal = Decimal("10000000")
    anomaly_items_max: int = 1_000_000
    alert_min_score: Decimal = Decimal("0.80")
    alert_max_error_rate: Decimal = Decimal("0.05")

    #: length cap of each text column
    text_limit: int = 500
    text_limits: dict[str, int] = field(default_factory=dict)

    #: True: growth outside -100..1000 % becomes NULL before the growth rule looks at it, so the rule never fires.
    strict_reference: bool = False
    #: True: product ids go through DOUBLE and lose their low digits (19-digit ids collapse).
    legacy_float_ids: bool = False
    #: True: the record hash uses DOUBLE revenue text and leaves NULL parts out.
    legacy_hash: bool = False

    #: lateness accepted by the streaming jobs
    watermark: str = "1 hour"

    def limit_for(self, column: str) -> int:
        return self.text_limits.get(column, self.text_limit)
