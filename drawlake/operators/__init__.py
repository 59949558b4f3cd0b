"""Dataflow operators over pages of readings."""
