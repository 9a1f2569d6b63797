"""Operations of a training-data pipeline: sharding, near copies, classifiers, scores, filters, mixes."""
