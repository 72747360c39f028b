"""Training-data operators: deduplication, filtering, mixing, archives and token stores."""
