"""adweave.operators."""
