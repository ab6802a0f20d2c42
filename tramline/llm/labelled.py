"""The bounded sample of labelled texts that a classifier learns from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.text import held_out, whole

#: At most so many labelled texts of each class, none longer than so many characters, reach the driver.
MAX_PER_CLASS, MAX_CHARS = 3000, 40_000


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS) -> tuple[pd.DataFrame, float]:
    """Texts and labels (columns text, n_chars, y) to learn from, and the share of label 1 among all that may be learnt from.

    Only rows that held_out() does not hold back are taken, those of smallest hash first, so the sample
    doesn't depend on how the tables are stored. Both classes have the same bound.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("_id").isNotNull())
    known = known.filter(~held_out(F.col("_id")))
    share = known.agg(F.avg("y")).first()[0]
    order = [F.xxhash64("_id"), F.col("_id")]
    some = known.filter("y = 1").orderBy(*order).limit(per_class).unionByName(known.filter("y = 0").orderBy(*order).limit(per_class))
    texts = docs.select(F.col("doc_id").alias("_doc"), whole(F.col("text")).alias("text")).filter(F.length("text") <= max_chars)
    rows = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("_id", "text", "y").toPandas()
    return rows.sort_values(["_id", "text"], kind="stable").reset_index(drop=True)[["text", "y"]], 0.0 if share is None else float(share)
