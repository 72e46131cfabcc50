"""Media-mix and journey-attribution analytics expressed as Spark plans."""
