"""Categorical log mining on PySpark: clean, count, encode and cluster tab-separated logs."""

from logmix.plans.clustering import Model, assign, fit, posterior
from logmix.plans.extraction import extract_text
from logmix.plans.growing import GrowingIndex, grow_index, recode
from logmix.plans.indexing import Index, index_features
from logmix.plans.logistic import train_logistic

__all__ = [
    "GrowingIndex",
    "Index",
    "Model",
    "assign",
    "extract_text",
    "fit",
    "grow_index",
    "index_features",
    "posterior",
    "recode",
    "train_logistic",
]
