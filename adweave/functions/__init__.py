"""adweave.functions."""
