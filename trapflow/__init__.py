"""trapflow: a Spark-first engine for notification streams and the tables made from them."""
