"""Sinks: routing, envelopes, delivery, reports."""
