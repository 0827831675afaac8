"""Scans, sinks and the views that map tables to telemetry relations."""
