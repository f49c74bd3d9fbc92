"""signalframe: motion and sensor time-series analytics on PySpark DataFrames."""
