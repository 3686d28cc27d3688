"""Mixing sources to target weights by balanced sampling (the cube method).

The largest mixture that the targets and the caps on repeats allow has
T = min over sources of max_repeats * tokens / share tokens.  A source then needs
f = share * T / tokens copies of each of its documents: floor(f) for certain,
and one more with inclusion probability f - floor(f).  The flight phase moves
these probabilities through the null space of two constraints, the numbers of
tokens and of documents, so that both totals stay exactly at their targets while
the probabilities become 0 or 1.  Each task flies over its own rows and leaves at
most two undecided documents a source besides a few held back; further flights
take those of many tasks, and landing tries every choice of the last few.
"""

from __future__ import annotations

import hashlib
import struct
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from .encode import token_counts

_EPS = 1e-9
#: Documents a source that landing tries all choices of.
RESERVE = 14
#: Documents a source that each flight holds back for the next one, which makes up for long ones.
HELD = 32


def _chance(seed: int, doc_id: int) -> float:
    """A number in [0, 1) that depends on the document only."""
    return struct.unpack("<Q", hashlib.blake2b(struct.pack("<qq", seed, doc_id), digest_size=8).digest())[0] / 2**64


class Flight:
    """The flight phase for one source, one document at a time.

    Holds at most two undecided documents between calls.
    """

    def __init__(self, seed: int = 0):
        self.seed = seed
        self.open: list[list] = []  # [doc_id, tokens, probability]

    def add(self, doc_id: int, tokens: int, p: float) -> list[tuple[int, int, int]]:
        """Documents that are decided now: (doc_id, tokens, 0 or 1)."""
        if p <= _EPS or p >= 1 - _EPS:
            return [(doc_id, tokens, round(p))]
        self.open.append([doc_id, tokens, p])
        return self._step() if len(self.open) == 3 else []

    def _step(self) -> list[tuple[int, int, int]]:
        (_, t1, p1), (_, t2, p2), (_, t3, p3) = self.open
        u = (t2 - t3, t3 - t1, t1 - t2)
        if not any(u):
            u = (1, -1, 0)
        probabilities = (p1, p2, p3)
        # how far the probabilities can go along u and against it
        ahead = min(((1 - p) / d if d > 0 else p / -d) for p, d in zip(probabilities, u) if d)
        back = min((p / d if d > 0 else (1 - p) / -d) for p, d in zip(probabilities, u) if d)
        go = ahead if _chance(self.seed, self.open[0][0] ^ (self.open[2][0] << 1)) * (ahead + back) < back else -back
        out, left = [], []
        for x, d in zip(self.open, u):
            x[2] = min(1.0, max(0.0, x[2] + go * d))
            if x[2] <= _EPS or x[2] >= 1 - _EPS:
                out.append((x[0], x[1], round(x[2])))
            else:
                left.append(x)
        self.open = left
        return out

    def land(self, rest: list[tuple[int, int, float]]) -> list[tuple[int, int, int]]:
        """Decides what is open and the rest, so that the tokens, then the documents, come closest to their targets.

        Tries every choice of at most RESERVE + 2 documents.
        """
        items = [*map(tuple, self.open), *rest]
        self.open = []
        if not items:
            return []
        tokens, p = np.array([x[1] for x in items], float), np.array([x[2] for x in items])
        picks = (np.arange(1 << len(items))[:, None] >> np.arange(len(items)) & 1).astype(float)
        miss = np.abs(picks @ tokens - tokens @ p) + 1e-3 * np.abs(picks.sum(1) - p.sum())
        best = picks[miss.argmin()]
        return [(x[0], x[1], int(k)) for x, k in zip(items, best)]


def settle_long(items: list[tuple[int, int, float]], seed: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Decides documents, longest first, that the others together could hardly make up for.

    The probabilities of the others change so that the expected tokens stay the
    same.  Returns the decided ones and the others.
    """
    out: list[tuple[int, int, int]] = []
    t, q = np.array([x[1] for x in items], float), np.array([x[2] for x in items], float)
    k = 0
    while len(items) - k > 2 and t[k] > 0.1 * (t[k + 1 :] * np.minimum(q[k + 1 :], 1 - q[k + 1 :])).sum():
        one = int(_chance(seed, items[k][0]) < q[k])
        out.append((items[k][0], items[k][1], one))
        missing = t[k] * (q[k] - one)
        k += 1
        if missing > 0:
            q[k:] += (1 - q[k:]) * min(1.0, missing / max(((1 - q[k:]) * t[k:]).sum(), 1e-9))
        else:
            q[k:] *= 1 - min(1.0, -missing / max((q[k:] * t[k:]).sum(), 1e-9))
    return out, [(x[0], x[1], float(y)) for x, y in zip(items[k:], q[k:])]


def plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source: tokens, target_share, max_repeats, copies (f) and wanted tokens.

    Targets without documents are left out of the minimum, as no mixture could
    contain them; their rows have copies null.
    """
    have = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    t = targets.groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.max("max_repeats").alias("max_repeats")).where("target_share > 0")
    joined = t.join(have, "source", "left")
    total = joined.where("tokens > 0").agg(F.min(F.col("max_repeats") * F.col("tokens") / F.col("target_share"))).scalar()
    return joined.select("source", "tokens", "target_share", "max_repeats", (F.col("target_share") * total / F.col("tokens")).alias("copies"), (F.col("target_share") * total).alias("wanted"))


def _snap(f: float) -> tuple[int, float]:
    whole = int(f + _EPS)
    return whole, max(0.0, f - whole) if f - whole > _EPS else 0.0


_CHOSEN = "doc_id long, source string, n_tokens long, copies int, p double, task int"


def _fly(items: list[tuple[int, int, float]], flight: Flight, hold: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, float]]]:
    """Flies over items, longest first, but for the last `hold`: those decided and those left."""
    cut = max(0, len(items) - hold)
    done = [d for x in items[:cut] for d in flight.add(*x)]
    left = [*((x[0], x[1], x[2]) for x in flight.open), *items[cut:]]
    flight.open = []
    return done, left


def _items(rest: pd.DataFrame) -> list[tuple[int, int, float]]:
    rest = rest.sort_values(["n_tokens", "doc_id"], ascending=False)
    return list(zip(rest["doc_id"].tolist(), rest["n_tokens"].tolist(), rest["p"].tolist()))


def mixture(docs: DataFrame, targets: DataFrame, seed: int = 7, vocabulary: str = "byte_bpe_50k", folder: str | None = None, fan: int = 1000) -> DataFrame:
    """(doc_id, source, n_tokens, copies): the documents of the mixture, each to be used so many times.

    Sizes are tokens of a public tokenizer.  Documents without tokens or with a
    source that is null or has no target aren't used; copies never exceed the
    source's max_repeats.  Documents of equal text are different documents.  Of
    rows with the same doc_id one is used.  What tasks leave undecided, at most
    HELD + 2 documents a source each, is flown over in rounds of `fan` tasks
    until one group of so many is left, which lands.  The shares don't depend on
    how documents fall into tasks, the choice of single documents does.
    """
    counted = token_counts(docs.where("doc_id is not null and source is not null"), ["doc_id", "source"], vocabulary=vocabulary, folder=folder)
    sizes = checkpointed(counted.where("n_tokens > 0").groupBy("doc_id").agg(F.max(F.struct("source", "n_tokens")).alias("v")).select("doc_id", "v.*"))
    planned = plan(sizes, targets)
    # one row per target, a fixed small table
    rows = sizes.join(F.broadcast(planned.where("copies is not null").select("source", "copies")), "source").select("doc_id", "source", "n_tokens", "copies")

    def fly(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        flights: dict[str, Flight] = {}
        held: dict[str, deque] = {}
        base: dict[str, int] = {}

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.int32()))], names=["doc_id", "source", "n_tokens", "copies", "p", "task"])

        for b in batches:
            out: list[tuple] = []
            for doc_id, source, n, f in zip(*(c.to_pylist() for c in b.columns)):
                whole, p = _snap(f)
                base[source] = whole
                if p == 0.0:
                    out.append((doc_id, source, n, whole, 0.0, task))
                    continue
                flight, wait = flights.setdefault(source, Flight(seed)), held.setdefault(source, deque())
                wait.append((doc_id, n, p))
                if len(wait) > HELD:
                    out += [(d, source, t, whole + one, 0.0, task) for d, t, one in flight.add(*wait.popleft())]
            if out:
                yield batch(out)
        left = [(d, s, t, base[s], p, task) for s, flight in flights.items() for d, t, p in [*flight.open, *held[s]]]
        if left:
            yield batch(left)

    def rows_of(rest: pd.DataFrame, done: list, left: list, task: int) -> pd.DataFrame:
        source, whole = rest["source"].iloc[0], int(rest["copies"].iloc[0])
        out = [(d, source, t, whole + one, 0.0, task) for d, t, one in done] + [(d, source, t, whole, p, task) for d, t, p in left]
        return pd.DataFrame(out, columns=[f.split()[0] for f in _CHOSEN.split(", ")])

    def again(key: tuple, rest: pd.DataFrame) -> pd.DataFrame:
        return rows_of(rest, *_fly(_items(rest), Flight(seed + 1), HELD), key[1])

    def land(rest: pd.DataFrame) -> pd.DataFrame:
        decided, items = settle_long(_items(rest), seed)
        flight = Flight(seed + 2)
        done, left = _fly(items, flight, RESERVE)
        return rows_of(rest, [*decided, *done, *flight.land(left)], [], 0)

    flown = checkpointed(rows.mapInArrow(fly, _CHOSEN))
    done, open_, tasks = flown.where("p = 0"), flown.where("p > 0"), flown.rdd.getNumPartitions()
    while tasks > fan:
        # at most fan * (HELD + 2) rows a group
        flown = checkpointed(open_.groupBy("source", F.expr(f"task div {fan}").cast("int").alias("task")).applyInPandas(again, _CHOSEN))
        done, open_, tasks = done.unionByName(flown.where("p = 0")), flown.where("p > 0"), -(-tasks // fan)
    landed = open_.groupBy("source").applyInPandas(land, _CHOSEN)
    return done.unionByName(landed).where("copies > 0").select("doc_id", "source", "n_tokens", "copies")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: documents, copies, tokens, the share reached, the target and the most repeats."""
    used = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum("copies").alias("copies"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_repeats")
    )
    total = used.agg(F.sum("tokens")).scalar()
    z = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return targets.select("source", "target_share", "max_repeats").join(used, "source", "left").select("source", "target_share", "max_repeats", z("documents"), z("copies"), z("tokens"), z("most_repeats"), F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6).alias("share"))
