"""lexiclust: text-corpus analytics as Spark DataFrame operators."""
