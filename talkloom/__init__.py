"""Talkloom: the data work around a chat model, written as Spark DataFrame transforms."""
