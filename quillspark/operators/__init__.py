"""DataFrame -> DataFrame operators (each one a Spark plan fragment)."""
