"""Training-data operators: token counts, deduplication, classification,
language-model scoring, packing and tokenisation, each as a Spark job."""
