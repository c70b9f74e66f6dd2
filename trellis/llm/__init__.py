"""Operations on corpora of training texts."""
