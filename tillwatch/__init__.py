"""Payment-fraud features, rules, models and ledger queries on Spark DataFrames."""
