"""Language-model scoring with a weighted backoff automaton.

Model: every word and every n-gram that the training rows have twice or more, counted over all of
them (``lm_tables``). Absolute discounting gives n-grams their probability; the backoff weight of a
context spreads what is left over the words it was not seen with, so every context sums to one; the
add-one unigram is below, whose unseen words share one part.

Automaton: a state is a kept n-gram shorter than the order (the root: no context). An arc reads a
word and leads to the state of the longest kept suffix; a state without an arc for the word hands
over to the state of its own longest suffix, its failure arc, at the cost of its backoff weight.
A chunk of texts builds the part of the automaton that its own n-grams can reach, and reads each
text once from left to right, carrying the state and adding log10 probabilities.

Cases: null text is the end token alone; the end is a token like a word; no training text: counts
zero, all words unknown; a null training mark: not learned from; null ids count as empty text for
the fold; equal rows are scored each; an empty table gives an empty table; other columns are not
read, and a kept column named like a result gets ``_in`` behind its name.
"""

from __future__ import annotations

import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.llm import lm_tables
from tillroll.llm.common import cleaning_shuffles, drop_staged
from tillroll.llm.lm_tables import Chunk
from tillroll.plans.staging import stage

ORDER = 3
DISCOUNT = 0.5
#: the end token: no word has white space in it
END = b"\n"
_RESULTS = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, then the end."""
    return lm_tables.tokens_of(text, END)


class Automaton:
    """The states and arcs that the n-grams of one chunk reach. State 0 is the root.

    By state: ``fail`` (the state of its longest suffix), ``backoff`` and ``depth`` (its words). By
    arc: ``weight`` and ``target``. ``arcs[d]`` has, for every token, the arc that reads it from
    the state of the ``d`` words before it, or -1. ``unseen`` is the root's weight for words never
    seen.
    """

    def __init__(self, chunk: Chunk, floor: int, discount: float):
        order = len(chunk.counts)
        self.unseen = -math.log10(floor)
        # states of every level, in order; an n-gram that is not kept has none
        state, depth, size = [], [np.zeros(1, np.int8)], 1
        for k, counts in enumerate(chunk.counts[: order - 1]):
            kept = counts > 0
            state.append(np.where(kept, size + np.cumsum(kept) - 1, 0))
            depth.append(np.full(int(kept.sum()), k + 1, np.int8))
            size += len(depth[-1])
        fail, backoff = np.zeros(size, np.int64), np.zeros(size)
        weights, targets, self.arcs, arcs = [], [], [], 0
        for k, counts in enumerate(chunk.counts):
            kept = np.flatnonzero(counts > 0)
            suffix = state[k - 1][chunk.suffix(k)[kept]] if k else np.zeros(len(kept), np.int64)
            if k < order - 1:
                own = state[k][kept]
                fail[own], backoff[own] = suffix, chunk.backoff[k][kept]
            else:
                own = suffix
            # one number more: tokens that end no n-gram of this length (-1) have no arc
            number = np.full(len(counts) + 1, -1, np.int32)
            number[kept] = arcs + np.arange(len(kept))
            self.arcs.append(number[chunk.at[k]])
            arcs += len(kept)
            weights.append(np.log10(chunk.chance(k, kept, floor, discount)))
            targets.append(own)
        # arrays of plain numbers: a list would hold an object for each
        self.fail, self.backoff = array("q", fail.tobytes()), array("d", backoff.tobytes())
        self.depth = array("b", np.concatenate(depth).tobytes())
        self.weight = array("d", np.concatenate(weights).tobytes())
        self.target = array("q", np.concatenate(targets).astype(np.int64).tobytes())

    def walk(self, first: int, last: int) -> float:
        """log10 probability of the text of tokens ``first`` to ``last``, from left to right."""
        total, state, depth = 0.0, 0, 0
        backoff, fail, depths = self.backoff, self.fail, self.depth
        weight, target, unseen = self.weight, self.target, self.unseen
        for arcs in zip(*(a[first:last].tolist() for a in self.arcs)):
            arc = arcs[depth]
            while arc < 0 and depth:
                total += backoff[state]
                state = fail[state]
                depth -= 1
                arc = arcs[depth]
            if arc < 0:
                total += unseen
            else:
                total += weight[arc]
                state = target[arc]
                depth = depths[state]
        return total


def score(
    docs: DataFrame,
    train: Column,
    keep: list[Column],
    text: str = "text",
    order: int = ORDER,
    discount: float = DISCOUNT,
) -> DataFrame:
    """Learn from the rows where ``train``, score all.

    Columns ``keep`` with n_tokens, n_known, train_tokens, base_score and score, staged; tables
    needed on the way are removed.
    """
    with cleaning_shuffles(docs.sparkSession):
        chunks = lm_tables.chunked(docs, keep, text, train, END)
        kind = chunks.schema["kept"].dataType.elementType.simpleString()
        learned = lm_tables.learn(chunks, order, discount)
        floor = learned.floor

        def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
            parts = []
            for kept, data in zip(chunks.column("kept").combine_chunks(), chunks.column("data")):
                chunk = lm_tables.told(data.as_py(), answers, order)
                automaton = Automaton(chunk, floor, discount)
                ends = np.cumsum(chunk.sizes)
                starts = ends - chunk.sizes
                known = (chunk.counts[0] > 0)[chunk.ids]
                base = np.log10((chunk.counts[0] + 1) / floor)[chunk.ids]
                total = [automaton.walk(a, b) for a, b in zip(starts.tolist(), ends.tolist())]
                parts.append(pa.table({
                    "kept": kept.values,
                    "n_tokens": pa.array(chunk.sizes, pa.int64()),
                    "n_known": np.add.reduceat(known.astype(np.int64), starts),
                    "base_score": np.add.reduceat(base, starts),
                    "score": pa.array(total, pa.float64()),
                }))
            return pa.concat_tables(parts)

        scored = learned.pairs.applyInArrow(
            run, f"kept {kind}, n_tokens bigint, n_known bigint, base_score double, score double"
        )
        scored = stage(scored, "scores")
        drop_staged(learned.staged)
    return scored.select(
        "kept.*", "n_tokens", "n_known", F.lit(learned.tokens).cast("bigint").alias("train_tokens"),
        "base_score", "score",
    )


def score_held_out(
    docs: DataFrame,
    held_out: Column,
    keep: list[str],
    text: str = "text",
    order: int = ORDER,
    discount: float = DISCOUNT,
) -> DataFrame:
    """Learn from the rows that are not ``held_out``, score all: columns ``keep``, then those
    of :func:`score` and ``held_out``."""
    named = [F.col(f"`{c}`").alias(f"{c}_in" if c in _RESULTS else c) for c in keep]
    return score(docs, ~held_out, [*named, held_out.alias("held_out")], text, order, discount)
