"""Incident timelines, event replay, state recovery and replay checks on Spark."""
