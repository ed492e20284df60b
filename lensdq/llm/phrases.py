"""Phrase collocations by set-oriented mining (SETM) of sorted occurrence relations.

The occurrence relation of length 1 holds every word under (piece, position). The relation of
length k is the merge join of the one of length k - 1 with the words at the next position of the
same piece; its groups are counted over the corpus, and the occurrences are semi-joined with the
frequent groups before the next length. Relations are sorted by piece and position and stored
packed, one row per block of pieces, so a merge join touches one block; the groups of a block travel
in packets by hash part, are counted there, and the part tells the blocks which are frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lensdq.llm.bpe import _packed, _unpacked
from lensdq.llm.common import bounded_join, saved

#: ``[.,;:!?\x0A-\x0D]`` end a piece, tab and space part its words.
ENDS = b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"
#: Frequent words of up to this many, about 40 bytes each, are broadcast to the block dictionaries; more are joined by shuffle.
FEW_GROUPS = 500_000


def _relations(batches: Iterator[pa.RecordBatch], block_chars: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one language each: a row with all words by position, and a row per distinct word.

    Words are numbered from 1 by frequency in the block, 0 ends a piece.
    """
    import numpy as np
    from pyspark import TaskContext

    cut = bytes.maketrans(ENDS + b"\t", b"\n" * len(ENDS) + b" ")
    block = TaskContext.get().partitionId() << 32

    class Numbers(dict):
        def __missing__(self, word):
            n = self[word] = len(self) + 1
            return n

    held: dict[str, tuple[Numbers, list]] = {}
    chars = 0

    def out() -> Iterator[pa.RecordBatch]:
        nonlocal block
        for lang, (numbers, parts) in held.items():
            first = np.concatenate(parts)
            counts = np.bincount(first, minlength=len(numbers) + 1)
            counts[0] = 0
            order = np.argsort(-counts[1:], kind="stable") + 1
            place = np.zeros(len(numbers) + 1, np.uint32)
            place[order] = np.arange(1, len(order) + 1, dtype=np.uint32)
            words = list(numbers)
            size = 1 + len(words)
            yield pa.record_batch(
                [
                    pa.array([block] * size, pa.int64()), pa.array([lang] * size, pa.string()), pa.array([None, *range(1, size)], pa.int32()),
                    pa.array([None, *[words[i - 1].decode() for i in order]], pa.string()), pa.array([None, *counts[order].tolist()], pa.int64()),
                    pa.array([_packed(place[first], "<u4"), *[None] * len(words)], pa.binary()),
                ],
                ["block", "lang", "local", "word", "n", "words"],
            )
            block += 1
        held.clear()

    for batch in batches:
        for lang, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = value.as_py() or b""
            numbers, parts = held.setdefault(lang, (Numbers(), []))
            known, ids = numbers.__getitem__, []
            for piece in raw.lower().translate(cut).split(b"\n"):
                found = piece.split()
                if found:
                    ids.extend(map(known, found))
                    ids.append(0)
            if ids:
                parts.append(np.array(ids, np.uint32))
            elif not parts:
                held.pop(lang)
            chars += len(raw)
            if chars >= block_chars:
                yield from out()
                chars = 0
    yield from out()


def _joined(at, group, words, step: int):
    """Merge join of occurrences with the words ``step`` positions after their start: start, group and next word."""
    after = words[at + step]
    met = after > 0
    return at[met], group[met], after[met]


def _dealt(g, w, parts: int):
    """Order of the groups (g, w) by hash part, and the part of each in that order."""
    import numpy as np

    code = g.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + w.astype(np.uint64)
    code ^= code >> np.uint64(32)
    code *= np.uint64(0xD6E8FEB86659FD93)
    part = ((code ^ (code >> np.uint64(32))) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, part[order]


def _groups(at, group, words, step: int, ids, gid):
    """Groups of the next length in a block: distinct (g, w) in order, the number of each joined occurrence, counts."""
    import numpy as np

    at, group, after = _joined(at, group, words, step)
    keys, number, n = np.unique(group * (len(ids) + 1) + after, return_inverse=True, return_counts=True)
    return at, number, gid[keys // (len(ids) + 1)], ids[keys % (len(ids) + 1) - 1], n


def _next_length(length: int, longest: int, parts: int):
    """Per block: semi-join the relation of ``length`` - 1 with its frequent groups, merge-join it to ``length``, deal its groups to parts.

    A packet holds the groups of a block that fall into one part, in an order the block finds
    again when the part tells by place which of them are frequent.
    """

    def run(blocks: pa.Table, frequent: pa.Table) -> pa.Table:
        import numpy as np

        out = {c: [] for c in ("block", "part", "g", "w", "n", "words", "ids", "gids", "at", "grp")}

        def add(**values) -> None:
            for c, column in out.items():
                column.append(values.get(c))

        for row in blocks.to_pylist() if frequent.num_rows else ():
            words = np.append(_unpacked(row["words"], "<u4").astype(np.int64), np.zeros(longest, np.int64))
            if length == 2:
                # Semi-join of the words: frequent ones are renumbered, others break their piece.
                local, gid = (frequent[c].to_numpy().astype(np.int64) for c in ("local", "gid"))
                renumber = np.zeros(max(int(words.max()), int(local.max())) + 1, np.int64)
                renumber[local] = np.arange(1, len(local) + 1)
                words, ids = renumber[words], gid
                at = np.flatnonzero(words)
                group = words[at] - 1
            else:
                ids = _unpacked(row["ids"], "<i8")
                if length == 3:
                    at, gid = np.flatnonzero(words), ids
                    group = words[at] - 1
                else:
                    at, group, gid = np.cumsum(_unpacked(row["at"], "<u4").astype(np.int64)), _unpacked(row["grp"], "<u4").astype(np.int64), _unpacked(row["gids"], "<i8")
                at, number, g, w, _ = _groups(at, group, words, length - 2, ids, gid)
                order, part = _dealt(g, w, parts)
                told = sorted(frequent.to_pylist(), key=lambda r: r["part"])
                first = np.searchsorted(part, [r["part"] for r in told])
                kept = [order[f + np.cumsum(_unpacked(r["places"], "<u4").astype(np.int64))] for f, r in zip(first, told, strict=True)]
                gid = np.concatenate([_unpacked(r["gids"], "<i8") for r in told])
                renumber = np.full(len(g), -1, np.int64)
                renumber[np.concatenate(kept)] = np.arange(len(gid))
                group = renumber[number]
                at, group = at[group >= 0], group[group >= 0]
                needed = np.zeros(len(words), bool)
                for step in range(length - 1, longest):
                    needed[at + step] = True
                words = np.where(needed, words, 0)
            _, _, g, w, n = _groups(at, group, words, length - 1, ids, gid)
            if not len(g):
                continue
            if length < longest:
                relation = {} if length == 2 else {"gids": _packed(gid, "<i8"), "at": _packed(np.diff(at, prepend=0), "<u4"), "grp": _packed(group, "<u4")}
                add(block=row["block"], words=_packed(words[:-longest], "<u4"), ids=_packed(ids, "<i8"), **relation)
            order, part = _dealt(g, w, parts)
            for own in np.split(np.arange(len(g)), np.flatnonzero(np.diff(part)) + 1):
                at_ = order[own]
                add(block=row["block"], part=int(part[own[0]]), g=_packed(g[at_], "<i8"), w=_packed(w[at_], "<i8"), n=_packed(n[at_], "<u4"))
        kinds = {"block": pa.int64(), "part": pa.int64()}
        return pa.table({c: pa.array(values, kinds.get(c, pa.binary())) for c, values in out.items()})

    return run, "block bigint, part bigint, g binary, w binary, n binary, words binary, ids binary, gids binary, at binary, grp binary"


def _counted(support: int):
    """Per part: counts of its groups over all blocks; the frequent ones, and for each packet their places and ids."""

    def run(packets: pa.Table) -> pa.Table:
        import numpy as np

        held = [packets[c].to_pylist() for c in ("block", "part", "g", "w", "n")]
        blocks, part = held[0], held[1][0]
        g, w = ([_unpacked(raw, "<i8") for raw in column] for column in held[2:4])
        edges = np.cumsum([0, *map(len, g)])
        g, w, n = np.concatenate(g), np.concatenate(w), np.concatenate([_unpacked(raw, "<u4") for raw in held[4]]).astype(np.int64)
        order = np.lexsort((w, g))
        new = np.r_[True, (g[order][1:] != g[order][:-1]) | (w[order][1:] != w[order][:-1])]
        starts = np.flatnonzero(new)
        total = np.add.reduceat(n[order], starts)
        often = total >= support
        gid = np.where(often, (part << 40) + np.cumsum(often) - 1, -1)
        of_entry = np.empty(len(g), np.int64)
        of_entry[order] = gid[np.cumsum(new) - 1]
        first = order[starts[often]]
        rows = [(None, None, None, None, *r) for r in zip(gid[often].tolist(), g[first].tolist(), w[first].tolist(), total[often].tolist(), strict=True)]
        for i, block in enumerate(blocks):
            own = of_entry[edges[i] : edges[i + 1]]
            places = np.flatnonzero(own >= 0)
            if len(places):
                rows.append((block, part, _packed(np.diff(places, prepend=0), "<u4"), _packed(own[places], "<i8"), None, None, None, None))
        names = ["block", "part", "places", "gids", "gid", "g", "w", "f"]
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        return pa.table({c: pa.array(list(values), pa.binary() if c in ("places", "gids") else pa.int64()) for c, values in zip(names, columns, strict=True)})

    return run, "block bigint, part bigint, places binary, gids binary, gid bigint, g bigint, w bigint, f bigint"


def phrase_counts(df: DataFrame, longest: int = 4, support: int = 30, text: str = "text", lang: str = "lang", block_chars: int = 32_000_000, part_words: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, length, f) of every word and phrase of up to ``longest`` words found ``support`` times or more
    in its language, and (lang, n) with all words of each language.

    A-Z are lowered; a phrase lies within a piece, overlaps count. ``block_chars`` bounds what a
    task holds of the texts at a time (a longer text is a block of its own); groups are counted in
    a part for every ``part_words`` words of the corpus. A null language is ``und``; a
    null, empty or blank text has no words; repeated rows count each; other columns are not read;
    an empty table gives empty results.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).cast("string").cast("binary").alias("text"))
    fields = "block bigint, lang string, local int, word string, n bigint, words binary"
    held = saved(docs.mapInArrow(lambda it: _relations(it, block_chars), fields), "words")
    of_words = held.where("local is not null").select("block", "lang", "local", "word", "n")
    counted = saved(of_words.groupBy("lang", "word").agg(F.sum("n").alias("f")), "word-counts")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = saved(counted.where(F.col("f") >= support).select(F.monotonically_increasing_id().alias("gid"), "lang", F.col("word").alias("phrase"), "f"), "frequent1")
    words = frequent
    known = bounded_join(of_words, words.withColumnRenamed("phrase", "word").select("lang", "word", "gid"), ["lang", "word"], frequent.count(), FEW_GROUPS).select(F.col("block").alias("home"), "local", "gid")
    state = held.where("local is null").select("block", "words")
    # A part has no more groups than its share of the words.
    parts = max(64, (totals.agg(F.sum("n")).first()[0] or 0) // part_words)
    found = [frequent.withColumn("length", F.lit(1))]
    for length in range(2, longest + 1):
        run, fields = _next_length(length, longest, parts)
        grown = saved(state.groupBy("block").cogroup(known.groupBy("home")).applyInArrow(run, fields), f"relation{length}")
        count, fields = _counted(support)
        told = saved(grown.where("part is not null").select("block", "part", "g", "w", "n").groupBy("part").applyInArrow(count, fields), f"groups{length}")
        named = told.where("gid is not null").select("gid", "g", "w", "f").join(frequent.select(F.col("gid").alias("g"), "lang", F.col("phrase").alias("head")), "g")
        named = named.join(words.select(F.col("gid").alias("w"), F.col("phrase").alias("tail")), "w")
        frequent = saved(named.select("gid", "lang", F.concat_ws(" ", "head", "tail").alias("phrase"), "f"), f"frequent{length}")
        found.append(frequent.withColumn("length", F.lit(length)))
        known = told.where("gid is null").select(F.col("block").alias("home"), "part", "places", "gids")
        state = grown.where("part is null").select("block", "words", "ids", "gids", "at", "grp")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.select("lang", "phrase", "length", "f"), totals


def collocations(counts: DataFrame, totals: DataFrame, covered: int = 80) -> DataFrame:
    """(lang, phrase, length, a, l, r, n, score) of the phrases of two words or more that no longer one covers.

    A cut of a phrase into two parts found l and r times scores floor(2000000 * a / (l + r)) in
    exact arithmetic; the lowest-scoring cut counts, ties to the shortest first part. A phrase
    goes if a longer one holds it and is found at least ``covered`` percent as often. Parts of a
    frequent phrase are frequent, so every part has its count.
    """
    phrases = counts.where("length > 1").withColumnRenamed("f", "a")
    parts = F.split("phrase", " ")
    piece = lambda first, size: F.array_join(F.slice(parts, first, size), " ")
    cuts = phrases.select("lang", "phrase", "length", "a", F.explode(F.transform(F.sequence(F.lit(1), F.col("length") - 1), lambda k: F.struct(k.alias("k"), piece(F.lit(1), k).alias("head"), piece(k + 1, F.col("length") - k).alias("tail")))).alias("c")).select("lang", "phrase", "length", "a", "c.*")
    head = counts.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tail = counts.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    score = F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))")
    scored = cuts.join(head, ["lang", "head"]).join(tail, ["lang", "tail"]).withColumn("score", score)
    best = scored.groupBy("lang", "phrase").agg(F.first("length").alias("length"), F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("b"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("length") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("length") - m + 1), lambda at: F.array_join(F.slice(parts, at, m), " "))))
    longer = counts.where("length > 2").select("lang", F.explode(inner).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    free = best.join(longer, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer").cast("decimal(20,0)") < covered * F.col("a").cast("decimal(20,0)")))
    return free.join(totals, "lang").select("lang", "phrase", "length", "a", "b.l", "b.r", "n", "b.score")


def ranked(found: DataFrame, most: int = 2000) -> DataFrame:
    """The first ``most`` phrases of each language by score, frequency and bytes; cut map-side before the shuffle."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return top.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
