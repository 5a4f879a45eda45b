"""Late-delivery model: features, split, training, scoring, evaluation."""
