"""Terms of one or several tokens, found in batches of token lists.

The terms form a trie over token numbers. All positions of a batch walk it together: at each depth the positions that
are still on a path take one step, which is a search among the trie's sorted edges. Every position begins a walk of
its own, so overlapping terms are all found and no failure links are needed; hardly any walk goes beyond the
first token. So terms of several tokens cost what their first tokens cost, and no run of tokens becomes a string.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Tokens looked up at once: a batch of long texts is cut, so a task's memory does not follow the lengths of texts and files.
SCAN_TOKENS = 500_000
GAP = "\x1f"  # between the tokens of a sequence that counts as one term; white space, so in no token


def token_slices(batch: pa.RecordBatch, column: str, most_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in parts of at most ``most_rows`` rows and SCAN_TOKENS tokens in the lists of ``column``; a row is never cut."""
    ends = np.cumsum(batch.column(column).value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SCAN_TOKENS, side="right"))
        end = max(at + 1, min(end, at + (most_rows or batch.num_rows)))
        yield batch.slice(at, end - at)
        at = end


class TermScan:
    """A list of different terms, numbered from 0; tokens of a term are joined by ``GAP``."""

    def __init__(self, terms: list[str]):
        split = [t.split(GAP) for t in terms]
        parts = sorted({p for term in split for p in term})
        number = {p: i for i, p in enumerate(parts)}
        edges: dict[int, int] = {}
        end, inner = {}, {0}
        for no, term in enumerate(split):
            state = 0
            for part in term:
                inner.add(state)
                state = edges.setdefault(state * len(parts) + number[part], len(edges) + 1)
            end[state] = no
        states = len(edges) + 1
        self.parts = pa.array(parts, pa.string())
        self.keys = np.array(sorted(edges), np.int64)
        self.next = np.array([edges[k] for k in self.keys.tolist()], np.int64)
        self.end = np.full(states, -1, np.int64)
        self.end[list(end)] = list(end.values())
        self.inner = np.zeros(states, bool)
        self.inner[list(inner)] = True
        # Without terms of several tokens a token's number tells its term, and nothing is walked.
        self.plain = None if len(inner) > 1 else self.end[self.next[np.argsort(self.keys)]]

    def occurrences(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, term number) of every occurrence of a term in the lists of tokens."""
        size = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(size)), size)
        if not len(row) or not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = pa.compute.index_in(tokens.flatten(), value_set=self.parts).fill_null(-1).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(code >= 0)
        if self.plain is not None:
            return row[at], self.plain[code[at]]
        state, depth = np.zeros(len(at), np.int64), 0
        rows, terms = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        while len(at):
            key = state * len(self.parts) + code[at + depth]
            edge = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[edge] == key
            at, state = at[on], self.next[edge[on]]
            found = self.end[state] >= 0
            rows.append(row[at[found]])
            terms.append(self.end[state[found]])
            depth += 1
            on = self.inner[state] & (at + depth < len(row))
            at, state = at[on], state[on]
            on = (row[at + depth] == row[at]) & (code[at + depth] >= 0)
            at, state = at[on], state[on]
        return np.concatenate(rows), np.concatenate(terms)
