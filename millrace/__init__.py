"""millrace: a Spark-first engine for data mining, sketches, graphs and recommenders."""

__version__ = "0.1.0"
