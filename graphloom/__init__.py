"""graphloom: Spark-first construction, sizing, lookup and QA derivation for text-bearing lexical graphs."""
