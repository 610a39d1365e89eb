"""Session memory as a stream."""
