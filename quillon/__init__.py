"""quillon: factor analytics and data processing as Spark DataFrame plans."""
