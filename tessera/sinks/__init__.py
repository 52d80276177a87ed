"""Sinks: result tables, manifests, metric exposition, log records."""
