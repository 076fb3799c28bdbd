"""Recordings, text sources, parameters and sinks."""
