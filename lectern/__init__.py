"""Answer-comparison analytics on Spark: two readers' answers in, scores, evidence, causes and statistics out."""
