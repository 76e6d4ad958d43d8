"""Training-data operators: token rollups, licence digests, substring and near
dedup, quality and toxicity classifiers, nearest neighbours, decontamination,
source mixing and language-model scoring. Nothing else in the library imports
this subpackage."""
