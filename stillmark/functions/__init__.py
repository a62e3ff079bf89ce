"""Column functions and Arrow UDFs for paths, sampling plans, formats, similarities and fingerprints."""
