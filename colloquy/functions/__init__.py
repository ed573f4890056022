"""Column functions: text, roles and times, paths, hashes. All are Spark expressions."""
