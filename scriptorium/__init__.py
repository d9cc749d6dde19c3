"""scriptorium: document-corpus analytics as Spark DataFrame transformations."""
