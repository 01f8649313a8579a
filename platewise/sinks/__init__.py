"""Sinks: table versions, report tables, CSV / JSON output."""
