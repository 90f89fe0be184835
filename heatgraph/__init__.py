"""heatgraph: hot-subnetwork analytics as PySpark DataFrame plans."""
