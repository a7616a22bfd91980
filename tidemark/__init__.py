"""Point-in-time analytics over deals, prices and evidence, written as Spark DataFrame operators."""
