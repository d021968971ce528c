"""Best-fit packing of documents into sequences, after Martello-Toth dominance reduction.

Documents are cut into pieces of at most ``capacity`` tokens (the first piece of
a document takes the remainder). Only the counts of the lengths decide how the
pieces are packed, and there are at most ``capacity`` of them, however many
pieces there are: they go to the driver, which plans whole groups of equal
sequences.

* Reduction: a length is fixed together with at most two others where that set
  dominates every other set with this length, by the conditions of Martello and
  Toth's reduction procedure; as often as the lengths last. Some best packing
  holds these sets, and the instance shrinks until nothing more is dominated.
* Best fit: what remains goes, longest first, each into the fullest sequence
  that has room, equal sequences and equal lengths at once.

Pieces are numbered within their length by two-level counting (task, then place
in the task), and a number's place in the plan gives sequence and offset. The
pieces are written to the checkpoint folder once, so texts are encoded once.

Defined cases: null and empty texts are one token, the end mark; repeated rows
and null ids are packed like any other; very long texts are cut whole; an empty
table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import shared_tokenizer
from .words import chunks

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
CAPACITY, END = 1024, 2
#: Numbers within a length are below 2^NUMBER.
NUMBER = 44


@dataclass
class Group:
    """``times`` equal sequences: runs of (length, how many), in order, and what is left of each."""

    left: int
    times: int
    runs: list[tuple[int, int]] = field(default_factory=list)

    def put(self, length: int, many: int, times: int) -> Group:
        return Group(self.left - length * many, times, [*self.runs, (length, many)])


def _dominant(count: np.ndarray, j: int, capacity: int) -> tuple[int, ...] | None:
    """The set with ``j`` that dominates all others with it, if one of at most three does."""
    room = capacity - j
    rest = count[: room + 1].copy()
    if j <= room:
        rest[j] -= 1
    sizes = np.flatnonzero(rest)
    if not len(sizes):
        return (j,)
    largest = int(sizes[-1])
    small = np.repeat(sizes[:3], np.minimum(rest[sizes[:3]], 3))[:3]  # the three smallest
    if largest == room or len(small) < 2 or small[:2].sum() > room:
        return (j, largest)
    if len(small) == 3 and small.sum() <= room:
        return None
    # at most two go with j: the pair with the highest sum, of equal ones that with the longest piece
    below = np.zeros(room + 1, np.int64)  # largest size up to here
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    limit = np.minimum(sizes, room - sizes)
    partner = np.where(limit > 0, below[np.maximum(limit, 0)], 0)
    alone = (partner == sizes) & (rest[sizes] < 2)
    partner[alone] = below[sizes[alone] - 1]
    sums = np.where(partner > 0, sizes + partner, 0)
    best = len(sums) - 1 - int(np.argmax(sums[::-1]))
    a, b = int(sizes[best]), int(partner[best])
    if largest >= sums[best]:
        return (j, largest)
    if a == largest:
        over = sizes[sizes > b]
        two = np.repeat(over[:2], np.minimum(rest[over[:2]], 2))[:2]
        if len(two) < 2 or two.sum() > room:
            return (j, a, b)
    return None


def reduce(count: np.ndarray, capacity: int) -> list[Group]:
    """Take from ``count`` (in place) the sets that dominate, as groups of sequences."""
    groups = []
    changed = True
    while changed:
        changed = False
        for j in np.flatnonzero(count)[::-1].tolist():
            while count[j] and (found := _dominant(count, j, capacity)):
                used: dict[int, int] = {}
                for s in found:
                    used[s] = used.get(s, 0) + 1
                times = int(min(count[s] // k for s, k in used.items()))
                for s, k in used.items():
                    count[s] -= k * times
                groups.append(Group(capacity - sum(found), times, sorted(used.items(), reverse=True)))
                changed = True
    return groups


def best_fit(count: np.ndarray, capacity: int) -> list[Group]:
    """Best fit, longest first, of ``count`` pieces of each length."""
    by_room: dict[int, list[Group]] = {}
    for s in np.flatnonzero(count)[::-1].tolist():
        left = int(count[s])
        while left:
            room = min((r for r in by_room if r >= s), default=None)
            group = Group(capacity, left) if room is None else by_room[room].pop()
            if room is not None and not by_room[room]:
                del by_room[room]
            many = group.left // s  # the next piece goes on into the same sequence while it has room
            times = min(group.times, left // many)
            placed = [group.put(s, many, times)] if times else []
            left -= times * many
            rest = group.times - times
            if rest and 0 < left < many:
                placed.append(group.put(s, left, 1))
                left, rest = 0, rest - 1
            if rest and room is not None:
                placed.append(Group(group.left, rest, group.runs))
            for g in placed:
                by_room.setdefault(g.left, []).append(g)
    return [g for gs in by_room.values() for g in gs]


@dataclass
class Plan:
    """Where the pieces of a length, by their numbers, stand: sorted by ``key`` (length and first number)."""

    key: np.ndarray
    many: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << NUMBER) + number, "right") - 1
        k = (length << NUMBER) + number - self.key[at]
        return self.sequence[at] + k // self.many[at], self.offset[at] + k % self.many[at] * length


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """The packing of so many pieces of each length."""
    count = np.zeros(capacity + 1, np.int64)
    for s, n in counts.items():
        count[s] = n
    if count.sum() >= 1 << NUMBER:
        raise ValueError("more pieces than the plan can number")
    groups = reduce(count, capacity) + best_fit(count, capacity)
    rows, numbered, base = [], np.zeros(capacity + 1, np.int64), 0
    for g in groups:
        at = 0
        for s, many in g.runs:
            rows.append(((s << NUMBER) + int(numbered[s]), many, base, at))
            numbered[s] += many * g.times
            at += s * many
        base += g.times
    rows.sort()
    return Plan(*(np.array([r[i] for r in rows], np.int64) for i in range(4)), base)


def pieces(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, task, place[, ids]``; ``place`` counts the pieces of a length in a task."""
    get = shared_tokenizer(docs, model)
    end = np.array([END], np.uint32)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "place"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        placed = [0] * (capacity + 1)
        for part in chunks(batches):
            tokenizer = get()
            cols: list[list] = [[] for _ in names]
            for doc, task, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), tokenizer.encode(part.column(1)), strict=True):
                ids = np.append(ids, end)
                at, length = 0, (len(ids) - 1) % capacity + 1
                for piece in range(-(-len(ids) // capacity)):
                    own = ids[at : at + length]
                    for col, v in zip(cols, (doc, piece, at, length, zlib.crc32(own), task, placed[length], own), strict=False):
                        col.append(v)
                    placed[length] += 1
                    at, length = at + length, capacity
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=False)], names)

    kind = "doc_id long, piece int, start long, length int, ids_crc32 long, task int, place long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.spark_partition_id().alias("task")).mapInArrow(run, kind)


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``pieces`` (as written, so that they stay as they are) with ``sequence_id`` and ``offset``."""
    per_task = cut_pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task")
    base = per_task.select(F.col("length").alias("l"), F.col("task").alias("t"), (F.sum("n").over(before) - F.col("n")).alias("base"))
    counts = {r.length: r.n for r in cut_pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    shared = cut_pieces.sparkSession.sparkContext.broadcast(plan(counts, capacity))
    keep = [c for c in cut_pieces.columns if c not in ("task", "place")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sequence, offset = shared.value.place(*(b.column(c).to_numpy().astype(np.int64) for c in ("length", "number")))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    numbered = cut_pieces.join(base, (F.col("length") == F.col("l")) & (F.col("task") == F.col("t"))).select(*keep, (F.col("base") + F.col("place")).alias("number"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut_pieces.schema if f.name in keep)
    return numbered.mapInArrow(run, f"{kind}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``, a row per piece."""
    return pack(cut(pieces(docs, capacity, model)), capacity)


def sequences(docs: DataFrame, capacity: int = CAPACITY, model: str = MODEL) -> DataFrame:
    """The training sequences themselves: ``sequence_id, ids, doc_ids, lengths`` (at most ``capacity`` ids a row)."""
    rows = pack(cut(pieces(docs, capacity, model, with_ids=True)), capacity)
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return rows.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.length").alias("lengths"))
