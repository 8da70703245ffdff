"""Operations on text, page, vector and media tables for preparing training data."""
