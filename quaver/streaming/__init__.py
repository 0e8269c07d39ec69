"""Nothing here reads or writes streams: notation arrives as finished documents, and no operator of the engine has state
that outlives a batch. All functions and most operators are stateless projections, and work on streaming DataFrames."""
