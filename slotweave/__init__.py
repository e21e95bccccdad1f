"""slotweave: evidence-backed form filling over a corpus, as Spark jobs."""
