"""Tables on Parquet: the mutation log, versioned documents, the key-value facade."""
