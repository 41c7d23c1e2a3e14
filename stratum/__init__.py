"""stratum: analytics over content-addressed object-store metadata, as Spark plans."""
