"""Evidence retrieval and ranking over Spark DataFrames.

Every public function takes DataFrames (or Columns) and returns a lazy
DataFrame (or Column); nothing here keeps global state.
"""
