"""Streaming counterparts of queue operators, on event time with explicit watermarks."""
