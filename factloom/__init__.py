"""factloom: record linkage, evidence fusion and scoring on PySpark."""
