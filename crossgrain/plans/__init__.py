"""The registered queries."""

from crossgrain.plans import allocation, books, evaluation, expressions, features, grouped, market, models, pit, quality, signals, streams, studies  # noqa: F401
