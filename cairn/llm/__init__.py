"""Training-data operators. Nothing outside this package (and the pipeline module) imports it."""
