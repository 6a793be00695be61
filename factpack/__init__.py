"""factpack: evidence packing and corpus relations as Spark DataFrame operators."""
