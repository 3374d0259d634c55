"""Privacy-preserving record linkage as Spark jobs.

Two person tables are turned into Bloom filters over hashed character bigrams, blocked with a multibit
tree, compared by Dice similarity and scored against a known truth.  Every operator is a function from
DataFrame to DataFrame; the caller owns the session.
"""
