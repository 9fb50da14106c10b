"""Entity resolution and link discovery as lazy Spark DataFrame operators."""
