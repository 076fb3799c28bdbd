"""Manifest matching, segments, merging, reports and exact ranks."""
