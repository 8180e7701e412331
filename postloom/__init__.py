"""Mail preparation, prompting and answer parsing as Spark plans."""
