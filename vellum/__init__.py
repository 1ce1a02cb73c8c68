"""vellum: PySpark jobs for landed web documents and for preparing training text."""
