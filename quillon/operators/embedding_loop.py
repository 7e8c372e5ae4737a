"""The embedding work loop (D17): works without a vector are encoded in batches; a batch that fails is tried again row by row, and
rows that fail alone go to a dead-letter table. Progress is kept in versions, so a run that stopped goes on where it was."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.lineage import cut
from quillon.sources.versions import Store

TABLES = {"vectors": ("work_id long, embedding array<double>", "work_id"), "dead": ("work_id long, error string, attempts int", "work_id")}


def pending(works: DataFrame, store: Store, attempts: int) -> DataFrame:
    """works (work_id, text) without a vector that have not failed so many times."""
    failed = store.read("dead").where(F.col("attempts") >= attempts).select("work_id")
    return works.join(store.read("vectors").select("work_id"), "work_id", "left_anti").join(failed, "work_id", "left_anti")


def encoded(rows: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch: int = 100) -> DataFrame:
    """work_id, embedding, error: each row's vector, or what went wrong with it alone. encode sees `batch` texts at most."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for lo in range(0, len(frame), batch):
                ids, texts = frame["work_id"].iloc[lo : lo + batch].tolist(), frame["text"].iloc[lo : lo + batch].tolist()
                errors: list[str | None] = [None] * len(ids)
                try:
                    found: list = list(encode(texts))
                    if len(found) != len(texts):
                        raise ValueError(f"{len(found)} vectors for {len(texts)} texts")
                except Exception:  # whatever the encoder raises: each text gets its own chance
                    found = []
                    for k, text in enumerate(texts):
                        try:
                            found.append(encode([text])[0])
                        except Exception as e:
                            found.append(None)
                            errors[k] = f"{type(e).__name__}: {e}"
                yield pd.DataFrame({"work_id": ids, "embedding": found, "error": errors})

    return rows.select("work_id", "text").mapInPandas(run, "work_id long, embedding array<double>, error string")


def run(works: DataFrame, store: Store, encode: Callable[[list[str]], list[list[float]]], batch: int = 100, slices: int = 4, attempts: int = 3) -> int:
    """One pass over the works without a vector; the store's version after it.

    Works go in slices by a hash of their id. A slice's vectors and failures are committed together when it is done; a run
    that breaks off loses one slice's work at most, and a later one takes up what has no vector. A failed work is tried in
    `attempts` runs at most; one that succeeds leaves the dead letters. Null texts count as empty; ids are unique.
    """
    works = works.select(F.col("work_id").cast("long").alias("work_id"), F.coalesce("text", F.lit("")).alias("text"))
    for k in range(slices):
        todo = pending(works.where(F.pmod(F.xxhash64("work_id"), F.lit(slices)) == k), store, attempts)
        done = cut(encoded(todo, encode, batch), "embedded")  # the encoder sees a text once, whatever reads its answer
        good, bad = done.where("error is null").select("work_id", "embedding"), done.where("error is not null").select("work_id", "error")
        parts, seen = store.touched("vectors", good), store.touched("dead", done)
        old = store.read("dead", seen)
        failed = bad.join(old.select("work_id", "attempts"), "work_id", "left").select("work_id", "error", (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"))
        changes = {"vectors": (store.read("vectors", parts).unionByName(good), parts), "dead": (old.join(done.select("work_id"), "work_id", "left_anti").unionByName(failed), seen)}
        if parts or seen:
            store.commit(changes, f"slice {k}")
    return store.latest()[0]
