"""barloom: market analytics for panels of price bars, written as Spark DataFrame operators."""
