"""The registered queries, by family. Each derives its input from the given tables by plain SQL that both engines read."""
