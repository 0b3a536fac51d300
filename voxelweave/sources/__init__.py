"""Reading and writing tables, vectors, report files, event logs and shards."""
