"""adweave.streaming."""
