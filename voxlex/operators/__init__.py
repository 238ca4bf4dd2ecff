"""DataFrame operators: transcript frames, response series, contexts,
embedding, statistics, splits, ridge and PCA."""
