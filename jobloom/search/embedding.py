"""Incremental embedding: pick the rows that need a vector, then make it."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from jobloom.functions.enrich import embedding_document, embedding_hash
from jobloom.operators.filters import fresh


def _parts():
    return [F.col(c) for c in ("title", "company_name", "skills", "career_stage", "workplace_type", "description_text")]


def plan_embedding(df: DataFrame, provider: str, as_of, days, cap: int) -> DataFrame:
    """Fresh rows with a link, their new hash, and what this pass does with each.

    A row whose vector is of this model and of its present text is ``skipped``;
    a row whose text changed is due again.  Newest-seen rows come first; ``cap`` is the size of one pass and rows past
    it are ``deferred`` to the next.
    """
    rows = fresh(df, as_of, days).filter(F.col("apply_url").isNotNull()).withColumns({
        "new_hash": embedding_hash(*_parts()), "document": embedding_document(*_parts()),
    })
    current = (
        F.col("embedding").isNotNull() & F.coalesce(F.col("embedding_hash") == F.col("new_hash"), F.lit(False))
        & F.coalesce(F.col("embedding_provider") == provider, F.lit(False))
    )
    due = rows.filter(~current)
    first = due.orderBy(F.desc("last_seen_at"), F.asc("id")).limit(cap).select("id", F.lit(True).alias("_now"))
    out = rows.join(first, "id", "left")
    outcome = F.when(current, "skipped").when(F.col("_now"), "selected").otherwise("deferred")
    return out.withColumn("outcome", outcome).drop("_now")


def hash_vectors(width: int = 64):
    """A stand-in model for tests: a unit vector seeded by the text."""

    def embed(texts):
        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode()).digest()[:4], "big")
            v = np.random.RandomState(seed).normal(size=width)
            out.append((v / np.linalg.norm(v)).astype(np.float32).tolist())
        return out

    return embed


def incremental_embed(df: DataFrame, provider: str, as_of, days, cap: int, embed=None) -> DataFrame:
    """(id, embedding, embedding_hash, embedding_provider, outcome) of a pass.

    ``embed`` maps a list of texts to vectors.  A batch that fails is reported
    as ``failed`` and the pass goes on.
    """
    embed = embed or hash_vectors()
    chosen = plan_embedding(df, provider, as_of, days, cap).filter(F.col("outcome") == "selected").select("id", "document", "new_hash")

    def run(batches):
        for pdf in batches:
            try:
                vectors, outcome = embed(pdf["document"].tolist()), "processed"
                if len(vectors) != len(pdf):
                    raise ValueError("one vector per text is required")
            except Exception:  # the failed slice is retried by the next pass
                vectors, outcome = [None] * len(pdf), "failed"
            yield pd.DataFrame({"id": pdf["id"], "embedding": vectors, "embedding_hash": pdf["new_hash"], "outcome": outcome})

    out = chosen.mapInPandas(run, "id long, embedding array<float>, embedding_hash string, outcome string")
    return out.withColumn("embedding_provider", F.lit(provider))
