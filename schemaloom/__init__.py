"""Schema enrichment, query-log graphs and bilingual question records on Spark DataFrames."""
