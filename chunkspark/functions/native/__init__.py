"""Plain-Python cores: no Spark here, so they can be tested and shipped to workers alone."""
