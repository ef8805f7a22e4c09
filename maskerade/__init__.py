"""maskerade: sensitive-data detection and reversible pseudonymisation as Spark plans."""
