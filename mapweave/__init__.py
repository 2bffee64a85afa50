"""mapweave: schema mapping, calibration and data-quality operators as lazy Spark plans."""
