"""Training-data operators: classification, scanning, tokenising, packing and near-duplicate detection."""
