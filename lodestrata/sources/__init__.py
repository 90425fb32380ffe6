"""Storage: the levelled Parquet store, binary codecs and the sketch registry."""
