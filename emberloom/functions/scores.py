"""Ranking, estimate and risk formulas as columns."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberloom import config as C


def rrf(*positions: Column, k: int = C.RRF_K) -> Column:
    """Reciprocal-rank fusion: the sum of 1/(k + position) over the retrievers that found the row."""
    return functools.reduce(operator.add, (F.coalesce(F.lit(1.0) / (p + k), F.lit(0.0)) for p in positions))


def reinforcement(now: Column, last_accessed: Column, indexed_at: Column, access_count: Column) -> Column:
    """A bounded bonus for recent and frequent access; never accessed counts from indexing."""
    age = F.greatest(F.lit(0.0), (now - F.coalesce(last_accessed, indexed_at)) / 86400.0)
    often = F.least(F.lit(1.0), F.log1p(F.coalesce(access_count, F.lit(0)).cast("double")) / F.log(F.lit(C.SATURATION + 1.0)))
    return C.REINFORCEMENT * (F.exp(-age / C.DECAY_DAYS) + often) / 2


def exact_match(query: str | Column, title: Column, content: Column) -> Column:
    """A bonus where the whole query stands in the title, or else in the content; a blank query gives none."""
    q = F.lower(F.trim(F.lit(query.strip()) if isinstance(query, str) else query))
    found = F.when(q == "", F.lit(0.0)).when(F.lower(title).contains(q), F.lit(C.TITLE_BONUS)).when(F.lower(content).contains(q), F.lit(C.CONTENT_BONUS))
    return found.otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    """Dot product in doubles over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def pert(low: Column, likely: Column, high: Column) -> tuple[Column, Column, Column]:
    """(expected, deviation, commitment): the commitment is rounded up to halves."""
    expected, deviation = (low + 4 * likely + high) / 6, (high - low) / 6
    return expected, deviation, F.ceil((expected + deviation) * 2) / 2


RISK_WEIGHTS = (0.25, 0.25, 0.20, 0.15, 0.15)


def weighted_risk(*parts: Column) -> Column:
    """Weighted mean of five scores from 0 to 10, each held to that range."""
    held = [F.least(F.lit(10.0), F.greatest(F.lit(0.0), p.cast("double"))) for p in parts]
    return functools.reduce(operator.add, (w * p for w, p in zip(RISK_WEIGHTS, held, strict=True)))


def risk_label(score: Column) -> Column:
    return F.when(score < 3, "low").when(score < 6, "medium").when(score < 8, "high").otherwise("critical")


def ceiling(onset: Column, memory: Column, slope: Column, intercept: Column, floor: int = C.FREE_FLOOR_BYTES) -> Column:
    """Sessions that fit: the observed onset, else what the regression leaves of memory; null without growth."""
    projected = F.floor((memory - floor - F.greatest(F.lit(0.0), intercept)) / slope)
    return F.coalesce(onset.cast("long"), F.when(slope > 0, F.greatest(F.lit(0).cast("long"), projected)))
