"""Structured Streaming entry points.

The reference reads three finished CSV extracts and has no stream, window,
watermark or state; nothing here adds operators. ``branch_stream`` only lets
the row-local part of the same cleaning chain run incrementally when branch
extracts arrive as files over time.
"""

from churnlens.streaming.branch_stream import clean_stream, write_stream  # noqa: F401
