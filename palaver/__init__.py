"""palaver: conversation-corpus analytics on Spark.

Every operator is a plain function from DataFrames and parameters to a DataFrame.
`sources` reads and writes, `functions` holds Column expressions, `operators` the
relational operators, `plans` the registered queries, `streaming` the keyed state.
"""
