"""codegrain: building, scoring and reporting code-completion datasets as Spark plans."""
