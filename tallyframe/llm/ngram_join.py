"""N-gram Jaccard join as a blocked sparse matrix product.

The incidence matrix has a row for each class of documents with equal shingle sets and a column for
each shingle. It is cut into blocks of columns, whose number follows the number of entries. A block
counts how many rows each of its columns has; entries of columns with a single row can't be part of
any overlap and are discarded there.

Every row's entries are then ordered by (rows of the column, column). Two sets of sizes x and y whose
Jaccard similarity reaches the threshold t overlap in at least t * max(x, y) entries, so they share
one of the first x - ceil(t * x) + 1 entries of either row. Rows that have that many entries of their
own are done. For the others the product runs over these rare columns, and pairs below the bounds
that follow from sizes and positions are discarded; the overlap of a pair that stays is counted from the
entries of its two rows, which gives the exact similarity (entries are 48-bit hashes of shingles, so two
shingles of a text of a million words agree with a chance of about 0.2 %).

Columns with many similar rows would give the square of their number in pairs. Instead, one pivot
row of each column is multiplied with all its rows, links found are contracted, and columns whose
rows all have one label are done. What is still mixed after some rounds is multiplied completely:
all rows outside a column's largest label with all rows of other labels, where overlaps with common
pivots bound those of the pairs. So no link between different labels is missed, and copies are
never expanded.

Shingles in more than one document of ``HOT_SHARE`` in any task's input skip the blocks, and their
counts go to every task: ``HOT_MOST`` shingles at most, else the share is raised until that holds. A
shingle that stays below has few entries then, about one part in ``HOT_MOST`` of all at most besides
that share, and goes through its block like any other, which is larger by no more than that.

Defined results: texts without words (and null texts) have no shingles and are linked with nothing;
texts with fewer words than ``width`` have one shingle, their whole sequence. Repeated rows are
copies. A null id never becomes the id of a component, unless it has no other. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import contracted
from .runtime import map_arrow, texts_of, written

#: Entries of a block of columns, on average.
BLOCK_ENTRIES = 2_000_000
#: Entries that a task gathers before it hands them to their blocks.
HELD_ENTRIES = 1_000_000
HOT_SHARE = 4096
HOT_LEAST = 8
#: Shingles whose counts go to every task, at most, and steps in which their share is raised for each power of two.
HOT_MOST = 1 << 18
HOT_STEPS = 8
#: Rounds with one pivot row for each column, before the rest is multiplied completely.
ROUNDS = 2
#: Bytes of a class, a hash of the set.
KEY = 10
#: Word hashes kept by a worker.
KEPT_WORDS = 200_000

_LOW48 = np.uint64((1 << 48) - 1)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the word sequences of a text.

    Words are separated by ASCII white space and A-Z is lower-cased, byte by byte.
    """
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    values = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    size = min(width, len(words))
    mixed = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        mixed ^= values[i : i + len(mixed)]
        mixed *= _M1
        mixed ^= mixed >> np.uint64(32)
        mixed *= _M2
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def set_key(entries: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(entries.tobytes())[:KEY]


def pack(values: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return wide.view(np.uint64).reshape(-1)


def membership(docs: DataFrame, id_column: str, text: str, width: int) -> DataFrame:
    """(id, class, n) of every row, and (shingle, m) of shingles frequent in a part of a task's input.

    The class, a hash of the set, is null for empty sets; rows of shingles have a null n.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    names = ["id", "class", "n", "shingle", "m"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        gathered: list[np.ndarray] = []
        held = 0
        nothing: pa.DataType | None = None

        def counted() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(gathered), return_counts=True)
            hot = counts >= max(HOT_LEAST, len(gathered) // HOT_SHARE)
            values, counts = pa.array(values[hot].astype(np.int64)), pa.array(counts[hot], pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(values), t) for t in (nothing, pa.binary(), pa.int64())] + [values, counts], names=names)

        for batch in batches:
            nothing = batch.column("id").type
            sets = [shingles(t, width, hashes) for t in texts_of(batch, 1)]
            classes = [set_key(s) if len(s) else None for s in sets]
            empty = pa.nulls(len(sets), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(classes, pa.binary()), pa.array(map(len, sets), pa.int64()), empty, empty], names=names)
            for own, key in zip(sets, classes):
                if key is not None and key not in seen:
                    seen.add(key)
                    gathered.append(own & _LOW48)
                    held += len(own)
            if held > HELD_ENTRIES:
                yield counted()
                gathered, seen, held = [], set(), 0
        if gathered:
            yield counted()

    return map_arrow(docs.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("_text")), task, f"id {kind}, class binary, n long, shingle long, m long")


def hot_columns(found: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The frequent shingles, sorted, with the sums of their counts; no more than ``HOT_MOST``."""
    counts = found.where("n is null").groupBy("shingle").agg(F.sum("m").alias("m"))
    level = F.floor(F.log2("m") * HOT_STEPS)
    frequent = counts.where(F.col("m") >= max(HOT_LEAST, rows // HOT_SHARE)).withColumn("level", level)
    # One row for each step of the share; the lowest level from which on all shingles are few enough.
    least, held = 0, 0
    for at, count in sorted(map(tuple, frequent.groupBy("level").count().collect()), reverse=True):
        held += count
        if held > HOT_MOST:
            least = at + 1
            break
    hot = frequent.where(F.col("level") >= least).select("shingle", "m").toArrow().sort_by("shingle")
    return hot.column("shingle").to_numpy().astype(np.uint64), hot.column("m").to_numpy().astype(np.uint32)


def narrow(counts: np.ndarray) -> bytes:
    """Counts with two bytes each where that is enough, else with four."""
    return counts.astype(np.uint16 if len(counts) and counts.max() < 1 << 16 else np.uint32).tobytes()


def keys_of(data: bytes) -> list[bytes]:
    return [data[i : i + KEY] for i in range(0, len(data), KEY)]


def counts_of(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, np.uint16 if len(data) == 2 * rows else np.uint32).astype(np.int64)


def packed_rows(place: np.ndarray, owner: np.ndarray, keys: np.ndarray, entries: np.ndarray, times: np.ndarray | None, sizes: np.ndarray | None) -> Iterator[tuple]:
    """Entries dealt to places: for each, the owners' keys and sizes, their counts, the entries, their columns' counts."""
    order = np.argsort(place, kind="stable")
    place, owner, entries = place[order], owner[order], entries[order]
    starts = np.flatnonzero(np.diff(place, prepend=-1)).tolist()
    for a, b in zip(starts, [*starts[1:], len(place)]):
        own, counts = np.unique(owner[a:b], return_counts=True)
        columns = b"" if times is None else times[order[a:b]].astype(np.uint32).tobytes()
        yield int(place[a]), keys[own].tobytes(), b"" if sizes is None else sizes[own].tobytes(), narrow(counts), pack(entries[a:b]), columns


PACKED = ("place", "keys", "sizes", "counts", "entries", "times")
PACKED_SCHEMA = "place int, keys binary, sizes binary, counts binary, entries binary, times binary"


def packed_batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    rows = list(rows)
    for i in range(0, len(rows), 64):
        columns = [pa.array(c, k) for c, k in zip(zip(*rows[i : i + 64]), [pa.int32(), *[pa.binary()] * 5])]
        yield pa.RecordBatch.from_arrays(columns, names=list(PACKED))


def homes(keys: np.ndarray, blocks: int) -> np.ndarray:
    return (keys[:, :4].copy().view(np.uint32).reshape(-1) % np.uint32(blocks)).astype(np.int64)


def column_blocks(docs: DataFrame, blocks: int, hot: tuple[np.ndarray, np.ndarray], text: str, width: int) -> DataFrame:
    """The entries of each distinct set of a task, dealt to blocks of columns.

    A row has the sets that meet a block: their keys, how many entries each has here, and the
    entries. Rows with sizes are for the place where a set's entries meet again, which its key
    names; they hold the sizes and the entries of hot columns, with the counts of these.
    """
    shared = docs.sparkSession.sparkContext.broadcast(hot)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, times = shared.value
        hashes, seen = WordHashes(), set()
        gathered: list[tuple[bytes, np.ndarray]] = []
        held = 0

        def dealt() -> Iterator[pa.RecordBatch]:
            keys = np.frombuffer(b"".join(k for k, _ in gathered), np.uint8).reshape(-1, KEY)
            sizes = np.array([len(s) for _, s in gathered], np.uint32)
            entries, owner = np.concatenate([s for _, s in gathered]), np.repeat(np.arange(len(sizes)), sizes)
            if len(values):
                at = np.minimum(np.searchsorted(values, entries), len(values) - 1)
                is_hot = values[at] == entries
            else:
                at, is_hot = np.zeros(len(entries), np.int64), np.zeros(len(entries), bool)
            cold = ~is_hot
            yield from packed_batches(packed_rows((entries[cold] % np.uint64(blocks)).astype(np.int64), owner[cold], keys, entries[cold], None, None))
            home, hot_owner, hot_entries = homes(keys, blocks), owner[is_hot], entries[is_hot]
            hot_times = times[at[is_hot]] if len(values) else np.zeros(0, np.uint32)
            yield from packed_batches(headed(home, keys, sizes, hot_owner, hot_entries, hot_times))

        def headed(home, keys, sizes, owner, entries, times) -> Iterator[tuple]:
            counts = np.bincount(owner, minlength=len(keys))
            ends = np.cumsum(counts)
            order = np.argsort(home, kind="stable")
            starts = np.flatnonzero(np.diff(home[order], prepend=-1)).tolist()
            for a, b in zip(starts, [*starts[1:], len(order)]):
                own = order[a:b]
                take = np.concatenate([np.arange(ends[i] - counts[i], ends[i]) for i in own])
                yield int(home[own[0]]), keys[own].tobytes(), sizes[own].tobytes(), narrow(counts[own]), pack(entries[take]), times[take].astype(np.uint32).tobytes()

        for batch in batches:
            for t in texts_of(batch):
                own = shingles(t, width, hashes)
                if len(own) and (key := set_key(own)) not in seen:
                    seen.add(key)
                    gathered.append((key, own & _LOW48))
                    held += len(own)
            if held > HELD_ENTRIES:
                yield from dealt()
                gathered, held = [], 0
        if gathered:
            yield from dealt()

    return map_arrow(docs.select(F.col(f"`{text}`").alias("_text")), task, PACKED_SCHEMA)


def counted_entries(packed: DataFrame, blocks: int) -> DataFrame:
    """Of each block, the entries in columns with two rows or more, dealt to the places of their sets."""

    def count(block: pa.Table) -> pa.Table:
        rows = list(zip(*(block.column(c).to_pylist() for c in PACKED)))
        ready = [r for r in rows if r[2]]
        parts = [(keys_of(r[1]), r[3], unpack(r[4])) for r in rows if not r[2]]
        # Sets that several tasks have met come several times, with the same entries.
        seen: set[bytes] = set()
        keys: list[bytes] = []
        chosen, counts = [], []
        for own, sizes, entries in parts:
            first = np.array([not (k in seen or seen.add(k)) for k in own])
            sizes = counts_of(sizes, len(own))
            keys += [k for k, f in zip(own, first) if f]
            counts.append(sizes[first])
            chosen.append(entries[np.repeat(first, sizes)])
        if keys:
            entries, owner = np.concatenate(chosen), np.repeat(np.arange(len(keys)), np.concatenate(counts))
            _, inverse, columns = np.unique(entries, return_inverse=True, return_counts=True)
            times = columns[inverse]
            shared = times >= 2
            entries, owner, times = entries[shared], owner[shared], times[shared]
            table = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY)
            ready += packed_rows(homes(table, blocks)[owner], owner, table, entries, times, None)
        columns = list(zip(*ready)) if ready else [[]] * 6
        return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.int32(), *[pa.binary()] * 5])], names=list(PACKED))

    return packed.groupBy("place").applyInArrow(count, PACKED_SCHEMA)


def open_rows(entries: DataFrame, percent: int) -> DataFrame:
    """Sets that may have a partner (class, n, entries, own, prefix).

    ``entries`` are those in columns with other rows, rarest first; ``own`` is the number of
    entries before them that no other row has; ``prefix`` the number to be multiplied.
    """

    def gather(place: pa.Table) -> pa.Table:
        numbers: dict[bytes, int] = {}
        sizes: dict[int, int] = {}
        owners, values, times = [], [], []
        for _, own, heads, counts, data, columns in zip(*(place.column(c).to_pylist() for c in PACKED)):
            keys = keys_of(own)
            owner = np.array([numbers.setdefault(k, len(numbers)) for k in keys])
            counts = counts_of(counts, len(keys))
            use = np.ones(len(keys), bool)
            if heads:
                use = np.array([o not in sizes for o in owner.tolist()])
                sizes.update((o, n) for o, n, u in zip(owner.tolist(), np.frombuffer(heads, np.uint32).tolist(), use) if u)
            chosen = np.repeat(use, counts)
            owners.append(np.repeat(owner, counts)[chosen])
            values.append(unpack(data)[chosen])
            times.append(np.frombuffer(columns, np.uint32)[chosen])
        owner, values, times = (np.concatenate(x) for x in (owners, values, times))
        n = np.array([sizes[i] for i in range(len(numbers))], np.int64)
        here = np.bincount(owner, minlength=len(n))
        first, own = n - (percent * n + 99) // 100 + 1, n - here
        is_open = own < first
        chosen = is_open[owner]
        owner, values, times = owner[chosen], values[chosen], times[chosen]
        order = np.lexsort((values, times, owner))
        offsets = np.concatenate([[0], np.cumsum(here[is_open])]).astype(np.int32)
        return pa.table(
            {
                "class": pa.array([k for k, u in zip(numbers, is_open) if u], pa.binary()),
                "n": pa.array(n[is_open]),
                "entries": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[order].astype(np.int64))),
                "own": pa.array(own[is_open]),
                "prefix": pa.array((first - own)[is_open]),
            }
        )

    return entries.groupBy("place").applyInArrow(gather, "class binary, n long, entries array<long>, own long, prefix long")


def possible(x: str, y: str, percent: int) -> Column:
    """Whether two sets that first meet in these cells can still be similar.

    Their overlap is at most what either has from its cell on. If both were multiplied with the same
    pivot, it is also at most the smaller of their overlaps with the pivot plus the smaller of the
    numbers of their other shared entries.
    """
    n1, n2 = F.col(f"{x}.n"), F.col(f"{y}.n")
    most = F.least(n1 - F.col(f"{x}.at"), n2 - F.col(f"{y}.at"))
    by_pivot = F.least(f"{x}.met", f"{y}.met") + F.least(F.col(f"{x}.shared") - F.col(f"{x}.met"), F.col(f"{y}.shared") - F.col(f"{y}.met"))
    most = F.when(F.col(f"{x}.pivot") == F.col(f"{y}.pivot"), F.least(most, by_pivot)).otherwise(most)
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (100 * most >= percent * (n1 + n2 - most))


def overlaps(pairs: DataFrame, rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, overlap, linked) of pairs of classes, by all entries of both."""
    one, two = (rows.select(F.col("class").alias(x), F.col("n").alias(f"n{x}"), F.col("entries").alias(f"e{x}")) for x in "ab")
    both = F.size(F.array_intersect("ea", "eb")).cast("long")
    linked = 100 * F.col("overlap") >= percent * (F.col("na") + F.col("nb") - F.col("overlap"))
    return pairs.join(one, "a").join(two, "b").withColumn("overlap", both).select("a", "b", "overlap", linked.alias("linked"))


def linked_classes(rows: DataFrame, percent: int) -> DataFrame:
    """(node, label) of the open classes: equal labels are connected by links."""
    prefix = F.posexplode(F.slice("entries", F.lit(1), F.col("prefix").cast("int")))
    cells = rows.select("class", "n", "own", F.size("entries").cast("long").alias("shared"), prefix)
    cells = cells.select("class", "n", "shared", F.col("col").alias("column"), (F.col("own") + F.col("pos")).alias("at"))
    several = cells.groupBy("column").agg(F.count("*").alias("m")).where("m > 1").select("column")
    cells = written(cells.join(several, "column"), "cells")
    labels = written(rows.select(F.col("class").alias("node"), F.col("class").alias("label")), "labels")
    nearest = labels.select(F.col("node").alias("class"), F.col("node").alias("pivot"), F.lit(None).cast("long").alias("met")).limit(0)
    for turn in range(ROUNDS + 1):
        named = cells.join(labels.withColumnRenamed("node", "class"), "class").join(nearest, "class", "left")
        parts = named.groupBy("column", "label").agg(F.count("*").alias("m"))
        mixed = parts.groupBy("column").agg(F.count("*").alias("labels"), F.max(F.struct("m", "label"))["label"].alias("main")).where("labels > 1")
        known = written(named.join(mixed.select("column", "main"), "column"), "open")
        if known.isEmpty():
            break
        cell = F.struct("class", "label", "n", "shared", "at", "pivot", "met")
        one = known.where("label != main") if turn else known
        if turn < ROUNDS:
            # The rows with the smallest share of own entries are nearest to the others.
            central = F.struct(F.expr("shared * 1000 div n"), F.xxhash64("class"), "class", cell.alias("x"))
            one = one.groupBy("column").agg(F.max(central).alias("most")).select("column", "most.x")
        else:
            one = one.select("column", cell.alias("x"))
        two = known.select("column", cell.alias("y"))
        met = one.join(two, "column").where((F.col("x.label") != F.col("y.label")) & possible("x", "y", percent))
        if turn < ROUNDS:
            pairs = met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
        else:
            pairs = met.select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b")).distinct()
        found = written(overlaps(pairs, rows, percent), "overlaps")
        labels = contracted(labels, found.where("linked"))
        if turn < ROUNDS:
            seen = found.groupBy(F.col("b").alias("class")).agg(F.max(F.struct(F.col("overlap").alias("met"), F.col("a").alias("pivot"))).alias("p"))
            own = found.select(F.col("a").alias("class")).distinct().join(rows.select("class", F.size("entries").cast("long").alias("met")), "class")
            now = seen.select("class", "p.pivot", "p.met").join(own.select("class"), "class", "left_anti").unionByName(own.select("class", F.col("class").alias("pivot"), "met"))
            nearest = written(now.unionByName(nearest.join(now, "class", "left_anti")), "nearest")
    return labels


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, class) of every row."""
    found = written(membership(docs, id_column, text, width), "members")
    members = found.where("n is not null").select("id", "class", "n")
    rows, total = members.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-total // BLOCK_ENTRIES))
    hot = hot_columns(found, rows)
    entries = counted_entries(column_blocks(docs, blocks, hot, text, width), blocks)
    labels = linked_classes(written(open_rows(entries, percent), "rows"), percent)
    classes = members.where("n > 0").groupBy("class").agg(F.min("id").alias("least"))
    labelled = classes.join(labels.withColumnRenamed("node", "class"), "class", "left").select("class", "least", F.coalesce("label", "class").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("least").alias("component_id"))
    named = labelled.join(smallest, "label").select("class", "component_id")
    some = members.where("n > 0").join(named, "class").select("id", "n", "component_id", "class")
    none = members.where("n = 0").select("id", "n", F.col("id").alias("component_id"), "class")
    return some.unionByName(none).select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), "component_id", "class")


def ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    return jaccard_components(docs).select("doc_id", "n_shingles", "component_id")
