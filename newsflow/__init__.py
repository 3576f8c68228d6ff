"""Spark jobs for streams of short documents that report on the same happenings."""

from newsflow.params import Params

__all__ = ["Params"]
