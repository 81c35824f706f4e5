"""gridloom: a Spark-first engine for gridded data, label maps, image sets and point sets."""
