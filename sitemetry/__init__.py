"""Website-visibility analytics as Spark jobs over whole tables."""
