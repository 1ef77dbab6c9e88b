"""Transforms and the session that plans them as one projection."""

from .session import FeatureSession, Sessions
from .transforms import (
    Bucketize,
    Constant,
    HashTrick,
    KMeansAssign,
    Logit,
    ModelInference,
    Ngram,
    Normalize,
    OneHot,
    PipelineModelTransform,
    Select,
    Transform,
    register_transform,
    transform,
)

__all__ = [x for x in dir() if not x.startswith("_")]
