"""Staleness on a stream of turns: per session a running fingerprint is held against what a stored quiz covers.

State is two hashes and a count per session, so it doesn't grow with a session's length. Turns of a session must arrive
in order; a turn whose index was seen already marks the session as diverged if its text differs from the stored chain.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "session_id string, state string, messages long, new_messages long"
STATE = "chain string, at_cover string, messages long"


def chained(before: str, role: str, text: str) -> str:
    """A fingerprint that grows turn by turn."""
    return hashlib.sha256(f"{before}\0{role}\0{text}".encode()).hexdigest()


def chain_of(turns: list[tuple[str, str]]) -> str:
    out = ""
    for role, text in turns:
        out = chained(out, role, text)
    return out


def states(turns: DataFrame) -> DataFrame:
    """turns (session_id, msg_idx, role, text, covered_messages, chain: both null without a quiz) -> OUT, an update per
    session and batch: new, fresh, extended or diverged."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain, at_cover, n = state.get if state.exists else ("", "", 0)
        covered, stored = None, None
        for rows in batches:
            for r in rows.sort_values("msg_idx").itertuples():
                covered, stored = (r.covered_messages, r.chain) if r.chain is not None and not pd.isna(r.covered_messages) else (covered, stored)
                if r.msg_idx < n:
                    continue  # seen before: a re-read file gives its turns again
                chain, n = chained(chain, r.role, r.text), n + 1
                at_cover = chain if covered is not None and n == covered else at_cover
        state.update((chain, at_cover, n))
        new = 0
        if stored is None:
            what = "new"
        elif n < covered:
            what = "diverged"
        elif at_cover and at_cover != stored:
            what = "diverged"
        else:
            new = int(n - covered)
            what = "extended" if new else "fresh"
        yield pd.DataFrame([(key[0], what, n, new)], columns=["session_id", "state", "messages", "new_messages"])

    return turns.groupBy("session_id").applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.NoTimeout)
