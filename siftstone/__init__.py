"""siftstone: file search, cataloguing and document analytics on Spark."""
