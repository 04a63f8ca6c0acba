"""lemmaflow: Spark analytics over step-by-step proof corpora and their dependency graphs."""
