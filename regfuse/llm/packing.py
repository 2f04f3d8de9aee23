"""Texts packed into containers of fixed capacity, with a certificate of how many containers any packing needs.

Sizes are tokens of a public tokenizer. Every task packs its texts by best-fit decreasing. Dual feasible functions
give a lower bound on the number of containers any packing of the same sizes needs; a task whose count equals its
bound is certified and its containers are final. The others keep their full containers and exchange the texts of the
rest: these are shuffled together into fewer tasks and packed again, until all meet their bounds, one task is left, or
the rounds are over. Tasks hold a fixed number of texts, so there are as many as the texts need. Bounds come out by task
(``certificates``) and for the whole (:func:`certificate`). A text over the capacity is cut into whole containers and a rest.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regfuse.session import Cut

CAPACITY, ROUNDS = 2048, 4
#: A container this full is final in any case.
FULL = 0.98
#: Texts a task packs; there are as many tasks as that takes.
TASK_ROWS = 5_000


def lower_bound(sizes: list[int] | dict[int, int], capacity: int) -> int:
    """Containers any packing needs: the best of the volume bound and dual feasible functions that round sizes up near
    1 and down near 0, and that count parts in steps of the k-th part. ``sizes`` may be counts by size."""
    count = Counter(sizes) if not isinstance(sizes, dict) else sizes
    if not count:
        return 0
    size = np.array(sorted(count), dtype=np.int64)
    n = np.array([count[int(s)] for s in size], dtype=np.int64)
    best = -(-int((size * n).sum()) // capacity)
    # sizes over capacity - e fill a container, those under e count nothing: for every size e up to a half
    volume, number = np.concatenate([[0], np.cumsum(size * n)]), np.concatenate([[0], np.cumsum(n)])
    e = size[2 * size <= capacity]
    low, high = np.searchsorted(size, e), np.searchsorted(size, capacity - e, side="right")
    if len(e):
        totals = (number[-1] - number[high]) * capacity + volume[high] - volume[low]
        best = max(best, -(-int(totals.max()) // capacity))
    for k in range(1, 9):
        # whole multiples of 1/(k + 1) stay, others are rounded down to k-ths
        parts = np.where(size * (k + 1) % capacity == 0, size * k, size * (k + 1) // capacity * capacity)
        best = max(best, -(-int((parts * n).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: list[tuple[int, int]], capacity: int) -> list[list[int]]:
    """Items (number, size) into the fullest container with room, largest first; ties by number."""
    free: list[tuple[int, int]] = []
    bins: list[list[int]] = []
    for i, s in sorted(sizes, key=lambda x: (-x[1], x[0])):
        at = bisect_left(free, (s, -1))
        if at < len(free):
            room, b = free.pop(at)
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(free, (room - s, b))
    return bins


def token_counts(texts: list[str], vocabulary: str) -> list[int]:
    """Tokens of texts by a byte-pair vocabulary file of the tokenizers library."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary)
    t.encode_special_tokens = True
    return [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def default_vocabulary() -> str:
    import os

    return os.environ.get("REGFUSE_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


def sized(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, tokens`` of every text; null and empty texts have none."""
    path, kind = vocabulary or default_vocabulary(), documents.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                yield pd.DataFrame({doc_id: part["_d"], "tokens": token_counts([t or "" for t in part["_t"]], path)})

    return documents.select(F.col(doc_id).alias("_d"), F.col(text).alias("_t")).mapInPandas(run, f"{doc_id} {kind}, tokens bigint")


def pack(sizes: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", size_col: str = "tokens", rounds: int = ROUNDS, certificates: bool = False) -> DataFrame:
    """Every item assigned to a container: ``id, part, start, size, container``.

    Items over the capacity are cut into full parts and a rest, no others. Items of size 0 or null come out in no
    container (null). Repeated ids are items of their own; an empty table gives none. Containers are named by text.

    ``certificates`` gives the tasks instead: ``step, task, texts, bins, bound``. A task packed its texts with as few
    containers as possible if ``bins`` equals ``bound``."""
    kind = sizes.schema[id_col].dataType.simpleString()
    base = sizes.select(F.col(id_col).alias("id"), F.coalesce(F.col(size_col), F.lit(0)).cast("bigint").alias("n"))
    cutup = base.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0)))))
    items = cutup.select("id", F.col("part").cast("bigint").alias("part"), (F.col("part") * capacity).cast("bigint").alias("start"), F.least(F.col("n") - F.col("part") * capacity, F.lit(capacity)).cast("bigint").alias("size"))
    columns = f"id {kind}, part bigint, start bigint, size bigint, container string, final boolean, step int, task int, bins bigint, bound bigint"
    done = items.filter("size <= 0 or size = " + str(capacity)).select("*", F.when(F.col("size") > 0, F.concat_ws("-", F.lit("w"), "id", "part", F.monotonically_increasing_id())).alias("container"))
    todo = Cut(items.filter(f"size > 0 and size < {capacity}"), "items")
    finished: list[Cut] = []
    tasks = max(1, -(-todo.rows // TASK_ROWS))
    for step in range(rounds):
        last = step == rounds - 1 or (tasks == 1 and step > 0) or todo.rows <= TASK_ROWS

        def run(batches: Iterator[pd.DataFrame], step=step, last=last) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            frames = list(batches)
            if not frames:
                return
            pdf = pd.concat(frames, ignore_index=True)
            n = pdf["size"].tolist()
            bins = best_fit_decreasing(list(enumerate(n)), capacity)
            bound = lower_bound(n, capacity)
            certified = len(bins) == bound
            where, final = [""] * len(n), [False] * len(n)
            for k, b in enumerate(bins):
                ok = last or certified or sum(n[i] for i in b) >= FULL * capacity
                for i in b:
                    where[i], final[i] = f"{step}-{TaskContext.get().partitionId()}-{k}", ok
            yield pdf.assign(container=where, final=final, step=step, task=TaskContext.get().partitionId(), bins=len(bins), bound=bound)

        out = Cut(todo.df.repartition(tasks, F.xxhash64("id", "part", F.lit(step))).mapInPandas(run, columns), f"packed{step}")
        todo.drop()
        finished.append(out)
        rest = out.df.filter("not final")
        if last or not rest.limit(1).count():
            break
        todo = Cut(rest.select("id", "part", "start", "size"), "items")
        tasks = max(1, -(-todo.rows // TASK_ROWS))
    if certificates:
        every = finished[0].df
        for f in finished[1:]:
            every = every.unionByName(f.df)
        return every.groupBy("step", "task").agg(F.count(F.lit(1)).alias("texts"), F.max("bins").alias("bins"), F.max("bound").alias("bound"))
    result = done.select("id", "part", "start", "size", "container")
    for f in finished:
        result = result.unionByName(f.df.filter("final").select("id", "part", "start", "size", "container"))
    return result.withColumnRenamed("id", id_col)


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """Texts of ``documents`` packed into containers of ``capacity`` tokens."""
    counts = Cut(sized(documents, vocabulary=vocabulary), "tokens")
    return pack(counts.df, capacity)


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """How good a whole packing from :func:`pack` is: ``containers``, the ``bound`` no packing of the same sizes can go under
    (from the counts by size, of which there are at most ``capacity``), and the share of the containers that is ``filled``."""
    used = packed.filter("container is not null")
    counts = {int(r["size"]): int(r["count"]) for r in used.groupBy("size").count().toLocalIterator()}
    containers = used.select("container").distinct().count()
    filled = sum(s * n for s, n in counts.items()) / (containers * capacity) if containers else None
    return packed.sparkSession.createDataFrame([(containers, lower_bound(counts, capacity), filled)], "containers bigint, bound bigint, filled double")
