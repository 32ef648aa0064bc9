"""verdance: vegetation-change analytics expressed as Spark DataFrame plans."""
