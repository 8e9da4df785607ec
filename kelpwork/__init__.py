"""kelpwork: dataset preparation on Spark DataFrames (scan, fingerprint, cluster, split, verify, report)."""
