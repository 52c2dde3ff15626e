"""ledgerlens: payments-fraud analytics as Spark DataFrame jobs.

Every operator takes a :class:`ledgerlens.sources.tables.Tables` bundle (or plain
DataFrames) and returns a DataFrame built from built-in Spark functions.  The result
is lazy, but building it may run small jobs: size checks of dimensions, the search for
hot keys, and, where a key is hot, a checkpoint of its rows.
"""

from ledgerlens.sources.tables import Tables

__all__ = ["Tables"]
