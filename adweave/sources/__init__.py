"""adweave.sources."""
