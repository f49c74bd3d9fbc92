"""Structured Streaming versions of the keyed, frame-ordered operators."""
