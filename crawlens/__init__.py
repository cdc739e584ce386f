"""crawlens: site-audit analytics as PySpark DataFrame operators."""
