"""Many strings found in many texts at once: an Aho-Corasick automaton as flat arrays, walked by NumPy lanes.

Bytes are mapped to classes (all bytes that no string has share one), so the table of a state has as many entries as the strings have different bytes. Texts are cut into
lanes that overlap by the longest string; all lanes of a batch take a step at a time, so the steps are as many as a lane is long, however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

#: Own bytes of a lane, and lanes walked together.
LANE, LANES = 512, 1 << 16


@dataclass(frozen=True)
class Automaton:
    """``step[state, class]``, the string that ends at a state (-1: none), and the next shorter state where one ends (0: none)."""

    classes: np.ndarray
    step: np.ndarray
    ends: np.ndarray
    shorter: np.ndarray
    longest: int


def build(strings: list[bytes]) -> Automaton:
    """The automaton of distinct, non-empty strings; their numbers are their places in the list."""
    used = sorted({b for s in strings for b in s})
    classes = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
    classes[used] = np.arange(1, len(used) + 1)
    width, size = len(used) + 1, 1 + sum(map(len, strings))
    step = np.zeros((size, width), np.int32)
    ends, fail, shorter = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
    # the trie, one position of all strings after the other
    codes = [classes[np.frombuffer(s, np.uint8)] for s in strings]
    order = sorted(range(len(strings)), key=strings.__getitem__)
    made, levels = 1, []
    at = np.zeros(len(strings), np.int32)
    for depth in range(max(map(len, strings), default=0)):
        live = np.array([i for i in order if len(strings[i]) > depth])
        code = np.array([codes[i][depth] for i in live])
        parent = at[live]
        key, which = np.unique(parent.astype(np.int64) * width + code, return_inverse=True)
        fresh = np.arange(made, made + len(key), dtype=np.int32)
        made += len(key)
        at[live] = fresh[which]
        levels.append((key // width, key % width, fresh))
        for i in live:
            if len(strings[i]) == depth + 1:
                ends[at[i]] = i
    step, ends, fail, shorter = step[:made], ends[:made], fail[:made], shorter[:made]
    # by length: what a state lacks it takes from the longest proper suffix that is a state
    for depth, (parent, code, state) in enumerate(levels):
        if depth:
            fail[state] = step[fail[parent], code]
        step[parent, code] = state
        shorter[state] = np.where(ends[fail[state]] >= 0, fail[state], shorter[fail[state]])
        if depth + 1 < len(levels):
            step[state] = step[fail[state]]
    if levels:
        last = levels[-1][2]
        step[last] = step[fail[last]]
    return Automaton(classes, step, ends, shorter, len(levels))


def find(machine: Automaton, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, string) of the texts ``raw[off[i]:off[i + 1]]``."""
    code = machine.classes[raw]
    lanes = -(-np.diff(off) // LANE)
    row = np.repeat(np.arange(len(lanes)), lanes)
    start = off[row] + LANE * (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes))
    stop = np.minimum(start + LANE + machine.longest - 1, off[row + 1])
    found = [np.empty(0, np.int64)]
    n = max(len(machine.ends), 1)
    for a in range(0, len(row), LANES):
        at, to, of = start[a : a + LANES].copy(), stop[a : a + LANES], row[a : a + LANES]
        state = np.zeros(len(at), np.int32)
        while True:
            live = at < to
            if not live.all():
                at, to, of, state = at[live], to[live], of[live], state[live]
            if not len(at):
                break
            state = machine.step[state, code[at]]
            at = at + 1
            hit, who = state, of
            while True:
                some = np.flatnonzero((machine.ends[hit] >= 0) | (machine.shorter[hit] > 0))
                if not len(some):
                    break
                hit, who = hit[some], who[some]
                own = machine.ends[hit] >= 0
                found.append(np.unique(who[own].astype(np.int64) * n + machine.ends[hit[own]]))
                hit = machine.shorter[hit]
        found = [np.unique(np.concatenate(found))]
    return found[0] // n, found[0] % n


def occurrences(texts: DataFrame, strings: list[str]) -> DataFrame:
    """``text_id`` and the other columns of ``texts`` but ``low``, with ``low_name`` for each distinct string that ``low`` contains; the automaton is broadcast."""
    kept = [c for c in texts.columns if c != "low"]
    machine = texts.sparkSession.sparkContext.broadcast((build([s.encode() for s in strings]), strings))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own, said = machine.value
        names = pa.array(said, pa.string())
        for batch in batches:
            col = batch.column(batch.schema.get_field_index("low")).cast(pa.large_string())
            off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
            data = col.buffers()[2]
            raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.empty(0, np.uint8)
            row, which = find(own, raw, off - off[0])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)).take(pa.array(row)) for c in kept), names.take(pa.array(which))], names=[*kept, "low_name"])

    fields = ", ".join(f"`{c}` {t}" for c, t in texts.select(*kept).dtypes)
    return texts.mapInArrow(run, f"{fields}, low_name string")
