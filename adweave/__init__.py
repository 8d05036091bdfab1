"""adweave: campaign-match analytics and corpus preparation on PySpark."""
