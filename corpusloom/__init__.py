"""corpusloom: a PySpark-native engine for analysing and preparing large text corpora."""
