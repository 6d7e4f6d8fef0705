"""docindex: Spark jobs that build and maintain a searchable document corpus."""
