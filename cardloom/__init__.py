"""Card-graph analytics on Spark: search, similarity graphs, taxonomy, corpus selection and event folds."""
