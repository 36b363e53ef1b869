"""pepspark: proteomics and mass-spectrometry analytics on Spark DataFrames."""
