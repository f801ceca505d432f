"""Expansion rounds: ask a source about the traversable entities that have paid nobody yet, load its answer, and go on."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..plans.store import cut
from .graph import expansion_frontier
from .load import insert_if_absent, rebuild_all


@dataclass
class Round:
    number: int
    asked: DataFrame
    inserted: int
    entities: DataFrame
    edges: DataFrame
    txns: DataFrame


def expand(entities: DataFrame, txns: DataFrame, ask: Callable[[DataFrame], DataFrame], rounds: int = 1, n: int = 8) -> Iterator[Round]:
    """Up to ``rounds`` rounds of ``n`` entities each; it ends when nobody is left to ask. Nobody is asked twice.

    ``ask``: from the entities asked to transactions like ``txns``; known ids are skipped. An entity comes into ``entities`` before
    its money does; the frontier is n rows, so each round's graph is what is distributed.
    """
    people, edges = rebuild_all(entities, txns)
    people, attempted = cut(people), None
    for number in range(1, rounds + 1):
        asked = cut(expansion_frontier(people, n, attempted))
        if asked.isEmpty():
            return
        attempted = asked.select("id") if attempted is None else attempted.unionByName(asked.select("id"))
        fresh = cut(insert_if_absent(txns, ask(asked), "id", ["id"]))
        txns = txns.unionByName(fresh.select(txns.columns))
        people, edges = rebuild_all(people, txns)
        people = cut(people)
        yield Round(number, asked, fresh.count(), people, edges, txns)
