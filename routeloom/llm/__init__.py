"""Operations of a training-data pipeline: deduplication, filters, tokenizing, formatting."""
