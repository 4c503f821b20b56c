"""Operations on training data: filters, deduplication, search, packing, tokens."""
