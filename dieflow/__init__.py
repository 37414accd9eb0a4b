"""dieflow: wafer-map analytics and training-data operators on PySpark."""
