"""Plumbline: evaluation analytics for tool-using question-answering models, as Spark DataFrame code."""
