"""weirlog: API request-log analytics written as Spark DataFrame operators."""
