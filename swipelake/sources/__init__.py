"""Readers, sinks, snapshots and generated rows."""
