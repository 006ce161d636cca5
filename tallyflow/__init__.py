"""tallyflow: analytics on streams of signed count updates, as Spark plans."""
