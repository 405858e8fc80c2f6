"""Media-provenance analytics on Spark: ledger, watermark, hashes, matching, audit."""
