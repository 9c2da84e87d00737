"""Tables of a session: their definitions, versions, and the Parquet folders and streams that back them."""
