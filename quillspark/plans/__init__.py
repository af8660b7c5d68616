"""Queries; importing this package registers them."""

from quillspark.plans import conversations, evaluation, files, generation, layouts, more, ranking, replies, rl, sampling, standard, supervision  # noqa: F401
