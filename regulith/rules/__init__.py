"""Rule tables: names, patterns and weights as data, one lexicon per language."""
