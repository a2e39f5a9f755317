"""Incremental generation: generate, exclude what is stored, append, until a quota (G-8)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.board import DEFAULT_BOARD, Board, with_canonical
from ..sources.store import VersionedStore, key_of


def keyed(tours: DataFrame, board: Board = DEFAULT_BOARD, up_to_symmetry: bool = False) -> DataFrame:
    """``tours`` with the 16-byte ``key`` of the sequence, or of its canonical form."""
    if up_to_symmetry:
        d = with_canonical(tours, board=board)
        return d.withColumn("key", key_of("canon")).drop("canon")
    return tours.withColumn("key", key_of("tour"))


def fill_to_quota(store: VersionedStore, candidates: Callable[[int], DataFrame], quota: int, board: Board = DEFAULT_BOARD,
                  up_to_symmetry: bool = False, max_turns: int = 1000) -> list[int]:
    """Turn by turn, ``candidates(turn)`` (rows with ``tour``; turns count from 0 over the
    life of the store) that are not stored yet are appended as a version, until ``quota`` rows
    are stored or a turn brings nothing new.  The last turn appends exactly what is missing, the rows of
    least key.  Returns the rows that each turn added; a filled store takes none."""
    added: list[int] = []
    turn = sum(r["kind"] == "turn" for r in store.log())
    while (missing := quota - store.n_rows()) > 0 and len(added) < max_turns:
        new = store.add_new(keyed(candidates(turn), board, up_to_symmetry), f"turn-{turn}", "turn", limit=missing)
        added.append(new)
        if not new:
            break
        store.compact()
        turn += 1
    return added
