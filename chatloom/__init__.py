"""chatloom: chat-log analytics on PySpark DataFrames."""
