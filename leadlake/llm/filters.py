"""Filters that keep whole rows by what a kernel says of their text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import langid, toxicity
from .text import parts


def where_text(docs: DataFrame, keep, text: str = "text") -> DataFrame:
    """Rows whose text passes `keep(texts) -> booleans`; all columns stay as they are."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for part, texts in parts(b, at):
                yield part.filter(pa.array(np.asarray(keep(texts), bool)))

    return docs.mapInArrow(run, docs.schema)


def not_toxic(docs: DataFrame, model: toxicity.Model, most: float = 0.5, text: str = "text") -> DataFrame:
    """Rows whose toxicity score is under `most`; null and empty texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_text(docs, lambda texts: np.array(toxicity.document_scores(texts, shared.value)[0]) < most, text)


def in_a_language(docs: DataFrame, model: langid.Model, least: float = 0.4, text: str = "text") -> DataFrame:
    """Rows of which one known language has at least the share `least`; texts without a letter go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(texts):
        name, score = langid.predict(texts, shared.value)
        return (np.array(name, object) != "und") & (score >= least)

    return where_text(docs, keep, text)
