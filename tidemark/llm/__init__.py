"""Operations of a training-data pipeline on raw text."""
