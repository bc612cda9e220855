"""barloom: market-data analytics as composable Spark DataFrame operators."""
