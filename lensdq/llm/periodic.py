"""Runs of repeated word sequences, from the enhanced suffix array of each text.

Documents of a batch are joined to one sequence in which every document has its own alphabet, so
their suffix arrays and LCP intervals stay apart. Every LCP interval of depth q is tested for
branching tandem repeats: a suffix i of a smaller child and the suffix q words further (or
before) lie in different children of the interval if and only if a square of period q stands
there that cannot be moved one word to the right. Such a square ends a run; moving it left gives
the run's start. No tree is built; intervals come from next-smaller links of the LCP array.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

#: Leaves of smaller children tested at a time.
LEAVES = 2_000_000


def _suffixes(symbols):
    """Suffix array, its inverse and its LCP array by doubling, and the ranks of all levels.

    Level t ranks the first 2^t words of every suffix; only suffixes not yet unique are sorted
    again. Suffixes that part in a round share the words of the level before, and the levels
    below tell how many more.
    """
    import numpy as np

    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    held = symbols[order]
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    lcp = np.zeros(n + 1, np.int64)
    levels, h = [rank], 1
    size = np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n]))
    open_ = order[size > 1]
    while len(open_):
        old = rank[open_].astype(np.int64)
        further = open_ + h
        second = np.where(further < n, rank[np.minimum(further, n - 1)], -1).astype(np.int64)
        resort = np.argsort(old * (n + 1) + second + 1, kind="stable")
        open_, old, second = open_[resort], old[resort], second[resort]
        new_old = np.r_[True, old[1:] != old[:-1]]
        here = np.arange(len(open_))
        slots = old + here - np.maximum.accumulate(np.where(new_old, here, 0))
        order[slots] = open_
        parted = ~new_old & np.r_[False, second[1:] != second[:-1]]
        lcp[slots[parted]] = h + _common(open_[parted] + h, open_[np.flatnonzero(parted) - 1] + h, levels)
        edge = new_old | parted
        rank = rank.copy()
        rank[open_] = np.maximum.accumulate(np.where(edge, slots, 0))
        levels.append(rank)
        group = np.flatnonzero(edge)
        wide = np.diff(np.r_[group, len(open_)])
        open_ = open_[np.repeat(wide, wide) > 1]
        h *= 2
    return order, rank, lcp, levels


def _common(a, b, levels):
    """Words that the suffixes ``a`` and ``b`` (never the same) share, by the ranks of falling levels."""
    import numpy as np

    n = len(levels[0])
    a, b = a.copy(), b.copy()
    shared = np.zeros(len(a), np.int64)
    for t in range(len(levels) - 1, -1, -1):
        rank, step = levels[t], 1 << t
        same = (a < n) & (b < n)
        same &= rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)]
        shared[same] += step
        a[same] += step
        b[same] += step
    return shared


def _followed(link, further):
    """Move the links of ``further`` on along the links themselves until none has to."""
    import numpy as np

    live = np.flatnonzero(further(np.arange(len(link)), link))
    while len(live):
        link[live] = link[link[live]]
        live = live[further(live, link[live])]
    return link


def _tandems(order, rank, lcp):
    """(start, period) of branching tandem repeats: smaller children's suffixes against their interval."""
    import numpy as np

    n = len(order)
    none = np.empty(0, np.int64)
    split = np.flatnonzero(lcp > 0)
    if not len(split):
        return none, none
    every = np.arange(n + 1)
    # Entries 0 and n have no common words and stop every link.
    before = _followed(np.maximum(every - 1, 0), lambda k, to: (lcp[k] > 0) & (lcp[to] > lcp[k]))
    low = _followed(before.copy(), lambda k, to: (lcp[k] > 0) & (lcp[to] >= lcp[k]))
    high = _followed(np.minimum(every + 1, n), lambda k, to: (lcp[k] > 0) & (lcp[to] >= lcp[k]))
    same = (lcp > 0) & (lcp[before] == lcp)
    first = _followed(np.where(same, before, every), lambda k, to: same[to])
    last = lcp > 0
    last[before[same]] = False
    ends = np.flatnonzero(last)
    interval = np.r_[first[split], first[ends]]
    start, stop = np.r_[before[split], ends], np.r_[split, high[ends]]
    low, high, depth = np.r_[low[split], low[ends]], np.r_[high[split], high[ends]], np.r_[lcp[split], lcp[ends]]
    size = stop - start
    by = np.lexsort((size, interval))
    largest = by[np.r_[interval[by][1:] != interval[by][:-1], True]]
    smaller = np.ones(len(interval), bool)
    smaller[largest] = False
    children = np.flatnonzero(smaller)
    upto = np.cumsum(size[children])
    starts, periods = [none], [none]
    at = 0
    while at < len(children):
        done = upto[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(upto, done + LEAVES, side="right")))
        own = children[at:end]
        c = np.repeat(own, size[own])
        slot = np.arange(len(c)) - np.repeat(np.cumsum(size[own]) - size[own], size[own]) + start[c]
        i, q = order[slot].astype(np.int64), depth[c]
        for step in (q, -q):
            j = i + step
            there = np.flatnonzero((j >= 0) & (j < n))
            t = rank[j[there]]
            d = c[there]
            hit = (t >= low[d]) & (t < high[d]) & ((t < start[d]) | (t >= stop[d]))
            there = there[hit]
            starts.append(np.minimum(i[there], j[there]))
            periods.append(q[there])
        at = end
    both = np.unique(np.stack([np.concatenate(starts), np.concatenate(periods)]), axis=1)
    return both[0], both[1]


def runs_of(symbols, begins, shortest: int, times: int):
    """Runs (start, length, period) of a sequence, sorted by start and period.

    ``symbols`` numbers the words so that no number occurs in two documents; ``begins`` is the
    first position of the document of every position. A run has a length of at least
    ``max(shortest, times * period)``.
    """
    import numpy as np

    if not len(symbols):
        return (np.empty(0, np.int64),) * 3
    order, rank, lcp, levels = _suffixes(symbols)
    at, q = _tandems(order, rank, lcp)
    room = at - begins[at]
    worth = room + 2 * q >= np.maximum(shortest, times * q)
    at, q, room = at[worth], q[worth], room[worth]
    # Moving the square left: the most words before it that equal those a period later.
    least, most = np.zeros(len(at), np.int64), room
    while (least < most).any():
        mid = (least + most + 1) // 2
        enough = _common(at - mid, at - mid + q, levels) >= mid
        least, most = np.where(enough, mid, least), np.where(enough, most, mid - 1)
    start, length = at - least, least + 2 * q
    long = length >= np.maximum(shortest, times * q)
    start, length, q = start[long], length[long], q[long]
    # One stretch found under several periods has the smallest.
    by = np.lexsort((q, length, start))
    start, length, q = start[by], length[by], q[by]
    own = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[own], length[own], q[own]
    by = np.lexsort((q, start))
    return start[by], length[by], q[by]


def _searched(batches: Iterator[pa.RecordBatch], shortest: int, times: int, block_words: int, text_at: int, names: list[str]) -> Iterator[pa.RecordBatch]:
    import numpy as np

    def out(rows: list[pa.RecordBatch], docs: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        flat = [numbers.setdefault(w, len(numbers)) for words in docs for w in words]
        sizes = np.array([len(d) for d in docs], np.int64)
        edges = np.r_[0, np.cumsum(sizes)]
        doc = np.repeat(np.arange(len(docs)), sizes)
        start, length, period = runs_of(doc * max(len(numbers), 1) + np.array(flat, np.int64), np.repeat(edges[:-1], sizes), shortest, times)
        change = np.zeros(edges[-1] + 1, np.int64)
        np.add.at(change, start + period, 1)
        np.add.at(change, start + length, -1)
        dropped = np.cumsum(change)[:-1] > 0
        texts = []
        for i, words in enumerate(docs):
            gone = dropped[edges[i] : edges[i + 1]]
            texts.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if gone.any() else b" ".join(words))
        home = doc[start] if len(start) else np.empty(0, np.int64)
        offsets = pa.array(np.searchsorted(home, np.arange(len(docs) + 1)), pa.int32())
        runs = pa.StructArray.from_arrays([pa.array(start - edges[home]), pa.array(length), pa.array(period)], ["start", "length", "period"])
        kept = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
        return pa.record_batch([*kept.columns, pa.array(sizes), pa.ListArray.from_arrays(offsets, runs), pa.array(texts, pa.binary()).cast(pa.string())], names)

    rows, docs, held = [], [], 0
    for batch in batches:
        first = 0
        for i, value in enumerate(batch.column(text_at)):
            words = (value.as_py() or b"").split()
            docs.append(words)
            held += len(words)
            if held >= block_words or len(docs) >= 20_000:
                rows.append(batch.slice(first, i + 1 - first))
                yield out([r.drop_columns([r.schema.names[text_at]]) for r in rows], docs)
                rows, docs, held, first = [], [], 0, i + 1
        if first < batch.num_rows:
            rows.append(batch.slice(first))
    if docs:
        yield out([r.drop_columns([r.schema.names[text_at]]) for r in rows], docs)


def periodic_runs(df: DataFrame, shortest: int = 6, times: int = 4, doc_id: str = "doc_id", text: str = "text", block_words: int = 300_000) -> DataFrame:
    """(doc_id, n_words, runs array<struct<start, length, period>>, collapsed) of every row.

    A run is a stretch of words with smallest period q and a length of at least ``max(shortest,
    times * q)`` that no neighbouring word extends keeping the period (``times`` of two or more);
    words are cut at ASCII white space and numbered from 0. ``collapsed`` joins by one space the
    words that no run holds after its first period. A text is searched whole; ``block_words``
    bounds how many words are searched together (a longer text is searched alone, in memory that
    grows with its words and the logarithm of its longest repeat).

    A null or blank text has no words, no runs and an empty ``collapsed``. Repeated rows and null
    ids keep their rows; other columns are not read; an empty table gives an empty result.
    """
    if times < 2:
        raise ValueError("a run holds its period at least twice")
    run = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    slim = df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    names = ["doc_id", "n_words", "runs", "collapsed"]
    schema = StructType([StructField("doc_id", slim.schema["doc_id"].dataType), StructField("n_words", LongType()), StructField("runs", ArrayType(run)), StructField("collapsed", StringType())])
    return slim.mapInArrow(lambda it: _searched(it, shortest, times, block_words, 1, names), schema).withColumnRenamed("doc_id", doc_id)
