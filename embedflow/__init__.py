"""embedflow: text-embedding pipelines and analytics over vectors as Spark DataFrames."""
