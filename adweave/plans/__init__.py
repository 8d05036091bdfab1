"""adweave.plans."""
