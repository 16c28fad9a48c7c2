"""Documents packed into training sequences of several context sizes.

A document's ids are routed by length: what fills a whole longest window leaves at once, the rest
goes to the smallest context size that holds it. Windows are built from the longest tier down; the gap of a
window is filled from shorter tiers by the longest piece that fits, and a last gap by cutting the
shortest piece. So every window of every tier is exactly full. What is left when a task ends is cut into
windows of powers of two, so there is no padding at all. Windows are dealt to step groups of equal
size in ids.

Each task packs its own input rows; no row is shuffled, and a task holds about ``BUFFER`` ids. The ids
depend on the text alone; the sequence numbers carry the task's number. A lost task is packed again as a whole.

Cases: a null text is an empty one (its end id alone); repeated rows are packed each; null doc_ids
stay null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import storage
from .text_ids import text_ids

BUFFER = 1 << 20
STEP_IDS = 1 << 16
PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_length long, step_group long, ids binary"


@dataclass(frozen=True)
class Rest:
    """What of a document is still to be packed."""

    doc: int | None
    ids: bytes
    start: int
    end: int

    @property
    def size(self) -> int:
        return self.end - self.start

    def cut(self, n: int) -> tuple[Rest, Rest]:
        return Rest(self.doc, self.ids, self.start, self.start + n), Rest(self.doc, self.ids, self.start + n, self.end)


class Packer:
    """``tiers``: context sizes, powers of two, ascending."""

    def __init__(self, tiers: tuple[int, ...]):
        self.tiers, self.longest = tiers, tiers[-1]
        self.pool: list[tuple[int, int, Rest]] = []  # by length; the number breaks ties
        self.count = self.held = 0

    def _keep(self, rest: Rest) -> None:
        self.count += 1
        self.held += rest.size
        insort(self.pool, (rest.size, self.count, rest))

    def _take(self, i: int) -> Rest:
        size, _, rest = self.pool.pop(i)
        self.held -= size
        return rest

    def add(self, doc: int | None, ids: bytes):
        """Yields the windows that the document fills alone."""
        rest = Rest(doc, ids, 0, len(ids) // 4)
        while rest.size >= self.longest:
            full, rest = rest.cut(self.longest)
            yield [full]
        if rest.size:
            self._keep(rest)

    def windows(self, until: int = 0):
        """Full windows, until at most ``until`` ids are held. The last may have any length."""
        while self.pool and self.held > until:
            window = [self._take(-1)]
            gap = next(t for t in self.tiers if t >= window[0].size) - window[0].size
            while gap and self.pool:
                i = bisect_right(self.pool, (gap, float("inf")))
                piece = self._take(max(0, i - 1))
                if not i:
                    piece, rest = piece.cut(gap)
                    self._keep(rest)
                window.append(piece)
                gap -= piece.size
            yield window


def power_windows(window: list[Rest]):
    """The window cut into windows whose lengths are powers of two, longest first."""
    size = sum(p.size for p in window)
    pieces = window[::-1]
    while size:
        length = 1 << (size.bit_length() - 1)
        size -= length
        part = []
        while length:
            piece = pieces.pop()
            if piece.size > length:
                piece, rest = piece.cut(length)
                pieces.append(rest)
            part.append(piece)
            length -= piece.size
        yield part


class Steps:
    """Deals windows to groups of ``STEP_IDS`` ids: each goes to the fullest group with room for it."""

    def __init__(self):
        self.room: list[tuple[int, int]] = []
        self.groups = 0

    def group(self, size: int) -> int:
        i = next((k for k, (room, _) in enumerate(self.room) if room >= size), None)
        if i is None:
            self.groups += 1
            room, group = STEP_IDS, self.groups - 1
        else:
            room, group = self.room.pop(i)
        if room > size:
            insort(self.room, (room - size, group))
        return group


def pack(docs: DataFrame, vocabulary: str, end: int, keeps_blanks: bool = False, tiers: tuple[int, ...] = (512, 1024, 2048, 4096)) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence, and its ids."""

    def packed(batches):
        import pyarrow as pa

        encoder, packer, steps = text_ids(vocabulary, keeps_blanks, end), Packer(tiers), Steps()
        first, made = storage.partition_number() << 33, 0
        types = [pa.int64()] * 8 + [pa.binary()]
        names = [x.split()[0] for x in PIECE.split(", ")]

        def rows(windows):
            nonlocal made
            found = []
            for window in windows:
                size, offset = sum(p.size for p in window), 0
                group = first + steps.group(size)
                for p in window:
                    found.append((p.doc, p.start, p.size, len(p.ids) // 4, first + made, offset, size, group, p.ids[4 * p.start : 4 * p.end]))
                    offset += p.size
                made += 1
            columns = zip(*found, strict=True) if found else [[]] * 9
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            for part, encoded in encoder.parts(batch):
                ready = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ready += packer.add(doc, ids)
                if packer.held > BUFFER:
                    ready += packer.windows(BUFFER // 4)
                yield rows(ready)
        last = [w for w in packer.windows()]
        whole = {t: t for t in tiers}
        yield rows([w for w in last if sum(p.size for p in w) in whole])
        yield rows([part for w in last if sum(p.size for p in w) not in whole for part in power_windows(w)])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(packed, PIECE)
