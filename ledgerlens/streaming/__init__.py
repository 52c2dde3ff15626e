"""Structured Streaming forms of the real-time fraud rules."""

from ledgerlens.streaming.detectors import (
    late_night_alerts,
    read_transactions,
    start,
    velocity_alerts,
)

__all__ = ["late_night_alerts", "read_transactions", "start", "velocity_alerts"]
