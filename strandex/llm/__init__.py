"""Training-data operators. Nothing outside this subpackage imports it, apart from the guarded import in __spark_entry__."""
