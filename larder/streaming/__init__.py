"""Streams of checks: an extension, nothing of it is in the batch audit."""
