"""Tunables that decide physical strategy, not results.

None of these change what a query returns; they pick between equivalent plans.
"""

from __future__ import annotations

# A dimension side is broadcast only when a row count proves it has at most this
# many rows; beyond it the join stays a shuffle join (sort-merge, with AQE skew
# splitting).  Dimensions are projected to the few columns a join needs first.
BROADCAST_MAX_ROWS = 2_000_000

# ... and only when its measured in-memory size (row overhead, fixed-width
# fields and the actual bytes of its text columns) is at most this many bytes.
BROADCAST_MAX_BYTES = 128 * 1024 * 1024

# Ordered per-key windows (running totals, ranks) cut the rows into chunks of about
# this many as soon as one key has more, so one hot account never lands in a single
# window task.
SKEW_TARGET_ROWS = 1_000_000
