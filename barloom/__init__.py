"""barloom: market-series and text analytics expressed as Spark DataFrame plans."""
