"""Background refresh of a corpus as a stream."""
