"""Streams over the append-only audit feed; each equals its batch result."""
