"""Variable-capacity best-fit packing of documents into training sequences."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count

#: Permitted sequence lengths, and what a sequence costs besides its length.
LENGTHS, OVERHEAD = (512, 1024, 2048, 4096), 32
#: Pieces that one task packs together.
SHARD = 20_000


class _Sizes:
    """A multiset of numbers from 0 to top that finds the largest one up to x, or the smallest from x on."""

    def __init__(self, top: int) -> None:
        self.items: list[list] = [[] for _ in range(top + 1)]
        self.bits = 0

    def add(self, size: int, item: object) -> None:
        self.items[size].append(item)
        self.bits |= 1 << size

    def pop(self, size: int) -> object:
        item = self.items[size].pop()
        if not self.items[size]:
            self.bits &= ~(1 << size)
        return item

    def from_(self, x: int) -> int:
        """Smallest size of at least x, or -1."""
        high = self.bits >> x
        return x + (high & -high).bit_length() - 1 if high else -1


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> list[tuple[int, int]]:
    """(bin, offset) of each size; sizes are at most the largest length. Bins are numbered as they open.

    Sizes are taken from the largest down, each into the open bin it leaves the least room in. If none has
    room, a bin opens with the length that promises the least cost for each unit of contents: the length and
    the overhead, over what the bin will hold if the sizes still to come fill it greedily.
    """
    top = max(lengths)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    left = [0] * (top + 1)
    for s in sizes:
        left[s] += 1
    present = 0
    for s, n in enumerate(left):
        if n and s:
            present |= 1 << s
    room, placed, fill = _Sizes(top), [(0, 0)] * len(sizes), []
    for i in order:
        s = sizes[i]
        left[s] -= 1
        if not left[s]:
            present &= ~(1 << s)
        free = room.from_(s)
        if free >= 0:
            b = room.pop(free)
        else:
            best = None
            for c in sorted(lengths):
                if c < s:
                    continue
                holds, used = s, {}
                while True:
                    some = present & ((1 << (c - holds + 1)) - 1)
                    x = some.bit_length() - 1
                    while x > 0 and used.get(x, 0) >= left[x]:
                        some &= ~(1 << x)
                        x = some.bit_length() - 1
                    if x <= 0:
                        break
                    take = min(left[x] - used.get(x, 0), (c - holds) // x)
                    used[x] = used.get(x, 0) + take
                    holds += take * x
                best = min(best or ((c + overhead) / max(holds, 1), c), ((c + overhead) / max(holds, 1), c))
            b, free = len(fill), best[1]
            fill.append(0)
        placed[i] = (b, fill[b])
        fill[b] += s
        room.add(free - s, b)
    return placed


def best_fit(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> DataFrame:
    """Pack the words of all documents into sequences of the permitted lengths.

    docs has doc_id and text. Returns a row for each piece: doc_id, piece (from 0), start (its first word in
    the document), length, bin_id, bin_offset, bin_length (smallest permitted length that holds the bin).

    A document longer than the largest length is cut into pieces of that length and a rest. Pieces are dealt
    into shards by a hash of what they are, whatever document or source they come from, and each shard is
    packed in one task by itself: a bin never crosses shards, which costs at most some open bins a shard.
    At the end each bin is downsized to its contents.

    Null or empty text: one piece of length 0 with no bin (null). Repeated rows are packed each for itself.
    A null doc_id is kept. Equal sizes are taken in the order of doc_id and piece, so reruns agree. An empty
    table gives an empty result. Other columns are ignored.
    """
    top = max(lengths)
    sized = docs.select("doc_id", word_count(F.col("text")).alias("_n"))
    pieces = sized.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(ceil(_n / {top}) - 1, 0) as int))")))
    pieces = pieces.withColumn("start", (F.col("piece") * F.lit(top).cast("long"))).withColumn("length", F.least(F.lit(top).cast("long"), F.col("_n") - F.col("start")).cast("int"))
    # At most half the bytes of a text are words, which bounds its pieces.
    most = docs.select(F.sum(F.lit(1) + F.floor(F.coalesce(F.octet_length("text"), F.lit(0)) / (2 * top)))).first()[0] or 0
    shards = max(1, -(-most // SHARD))
    pieces = pieces.withColumn("_s", F.pmod(F.xxhash64("doc_id", "piece", "_n"), F.lit(shards)).cast("int")).drop("_n")

    def place(table: pa.Table) -> pa.Table:
        ids, piece, length = (table.column(c).to_pylist() for c in ("doc_id", "piece", "length"))
        shard = table.column("_s")[0].as_py() if table.num_rows else 0
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0, piece[i], length[i]))
        some = [i for i in order if length[i]]
        placed = pack([length[i] for i in some], lengths, overhead)
        fill: dict[int, int] = {}
        for i, (b, _) in zip(some, placed, strict=True):
            fill[b] = fill.get(b, 0) + length[i]
        size = {b: min(c for c in lengths if c >= n) for b, n in fill.items()}
        where = {i: at for i, at in zip(some, placed, strict=True)}
        rows = [where.get(i) for i in range(len(ids))]
        return pa.table({
            "doc_id": table.column("doc_id"), "piece": table.column("piece"), "start": table.column("start"), "length": table.column("length"),
            "bin_id": pa.array([f"{shard}-{r[0]}" if r else None for r in rows], pa.string()),
            "bin_offset": pa.array([r[1] if r else None for r in rows], pa.int32()),
            "bin_length": pa.array([size[r[0]] if r else None for r in rows], pa.int32()),
        })

    return pieces.groupBy("_s").applyInArrow(place, "doc_id long, piece int, start long, length int, bin_id string, bin_offset int, bin_length int")
