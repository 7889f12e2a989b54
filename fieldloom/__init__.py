"""fieldloom: labelled-ensemble panel analytics on PySpark."""
