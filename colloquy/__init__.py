"""colloquy: conversation analytics on Spark DataFrames and message streams."""
