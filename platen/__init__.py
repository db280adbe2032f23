"""platen: document-corpus auditing and conversion-chain scoring on Spark DataFrames."""
