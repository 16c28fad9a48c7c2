"""State per run for live operators: which rows are final, and the values before them.

A run's newest rows are held in its state. They become final when a row has come that is newer by more than the lateness
bound, or when a timer finds that no row has come for a while. A second, later timer removes the state of a run that
has ended. Values of processes that a run has not shown for ``forget`` seconds of its own time are removed as well,
so the state follows what is alive and not all that has ever been seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

KIND, EARLIER = "_kind", "_earlier"
FINAL, OPEN, LATE, SEEN = "final", "open", "late", "seen"


class Held(StatefulProcessor):
    """Holds rows back; subclasses add the values before a row (`looked_back`).

    ``idle``: seconds without a row after which a timer releases the rest, None for queries without timers.
    """

    def __init__(self, schema: StructType, at: str, lateness: float, idle: float | None, forget: float):
        self.schema, self.at, self.lateness, self.idle, self.forget = schema, at, lateness, idle, forget
        self.names = schema.names

    def added(self) -> list[StructField]:
        return []

    @property
    def shape(self) -> StructType:
        plain = [StructField(f.name, f.dataType) for f in self.schema.fields]
        return StructType([*plain, *self.added(), StructField(KIND, StringType())])

    def like(self, name: str, field: str) -> StructField:
        return StructField(name, self.schema[field].dataType)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", StructType([StructField(f.name, f.dataType) for f in self.schema.fields]))
        self.times = handle.getValueState("times", "border double, newest double")
        self.keep(handle)

    def keep(self, handle) -> None:
        """State variables of a subclass."""

    def handleInputRows(self, key, rows: Iterable[Row], timerValues) -> Iterator[Row]:
        border, newest = self.times.get() if self.times.exists() else (None, None)
        held, late = self.held(), []
        for row in map(tuple, rows):
            moment = row[self.names.index(self.at)]
            if moment is None or border is not None and moment < border:
                late.append(row)
                continue
            held.append(row)
            newest = moment if newest is None else max(newest, moment)
        for row in late:
            yield self.out(LATE, row)
        if newest is not None:
            border = max(newest - self.lateness, -math.inf if border is None else border)
        yield from self.released(key, held, border, newest)
        if self.idle is not None:
            self.arm(timerValues.getCurrentProcessingTimeInMs() + self.idle * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        border, newest = self.times.get() if self.times.exists() else (None, None)
        held = self.held()
        if held:
            yield from self.released(key, held, math.nextafter(newest, math.inf), newest)
            self.arm(timerValues.getCurrentProcessingTimeInMs() + self.forget * 1000)
        else:  # the run has ended
            self.times.clear()
            self.drop()

    def close(self) -> None:
        pass

    def held(self) -> list[tuple]:
        return [tuple(r) for r in self.open.get()] if self.open.exists() else []

    def arm(self, moment: float) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(moment))

    def released(self, key, held: list[tuple], border: float | None, newest: float | None) -> Iterator[Row]:
        moment = lambda row: row[self.names.index(self.at)]
        rest = [r for r in held if moment(r) >= border]
        if final := [r for r in held if moment(r) < border]:
            yield from (self.out(FINAL, r, more) for r, more in self.looked_back(self.ordered(final), True))
        if self.idle is None:
            yield self.out(SEEN, tuple(key[0] if n == "run_id" else None for n in self.names))
            yield from (self.out(OPEN, r, more) for r, more in self.looked_back(self.ordered(rest), False))
        if rest:
            self.open.put(rest)
        else:
            self.open.clear()
        if newest is not None:
            self.times.update((float(border), float(newest)))

    def ordered(self, rows: list[tuple]) -> list[tuple]:
        places = [self.names.index(c) for c in (self.at, "row_ord") if c in self.names]
        return sorted(rows, key=lambda r: tuple((r[p] is not None, r[p]) if r[p] is not None else (False, 0) for p in places))

    def looked_back(self, rows: list[tuple], final: bool) -> Iterator[tuple[tuple, tuple]]:
        """Rows with the values of `added`; what later rows need is kept if they are ``final``."""
        yield from ((r, ()) for r in rows)

    def drop(self) -> None:
        """Clear the state variables of a subclass."""

    def out(self, kind: str, row: tuple, more: tuple = ()) -> Row:
        values = [*row, *(more or (None,) * len(self.added())), kind]
        return Row(**dict(zip(self.shape.names, values, strict=True)))


class Samples(Held):
    """The sample before."""

    def __init__(self, *args, before: list[str]):
        super().__init__(*args)
        self.before = before

    def added(self) -> list[StructField]:
        return [self.like(f"_p_{c}", c) for c in self.before]

    def keep(self, handle) -> None:
        self.last = handle.getValueState("last", StructType([self.like(c, c) for c in self.before]))

    def looked_back(self, rows, final):
        last = tuple(self.last.get()) if self.last.exists() else (None,) * len(self.before)
        for row in rows:
            yield row, last
            last = tuple(row[self.names.index(c)] for c in self.before)
        if final:
            self.last.update(last)

    def drop(self) -> None:
        self.last.clear()


class Entities(Held):
    """The run's previous tick, and the values before of a process or adapter."""

    def __init__(self, *args, entity: str, before: list[str]):
        super().__init__(*args)
        self.entity, self.before = entity, before

    def added(self) -> list[StructField]:
        return [StructField("prev_tick", DoubleType()), *[self.like(f"_p_{c}", c) for c in self.before]]

    def keep(self, handle) -> None:
        values = StructType([StructField("seen", DoubleType()), *[self.like(c, c) for c in self.before]])
        self.last = handle.getMapState("last", StructType([self.like(self.entity, self.entity)]), values)
        self.ticks = handle.getValueState("ticks", "newest double, earlier double")

    def values_before(self, value: tuple | None, previous: float | None) -> tuple:
        return (None,) * len(self.before) if value is None else tuple(value[1:])

    def looked_back(self, rows, final):
        at, own = self.names.index(self.at), self.names.index(self.entity)
        newest, earlier = self.ticks.get() if self.ticks.exists() else (None, None)
        changed: dict = {}
        for row in rows:
            if newest is None or row[at] > newest:
                newest, earlier = float(row[at]), newest
            which = row[own]
            if which in changed:
                value = changed[which]
            else:
                value = tuple(self.last.getValue((which,))) if which is not None and self.last.containsKey((which,)) else None
            yield row, (earlier, *self.values_before(value, earlier))
            changed[which] = (float(row[at]), *(row[self.names.index(c)] for c in self.before))
        if final:
            for which, value in changed.items():
                if which is not None:
                    self.last.updateValue((which,), value)
            self.ticks.update((newest, earlier))
            gone = [k for k, v in self.last.iterator() if v[0] < newest - self.forget]
            for k in gone:
                self.last.removeKey(tuple(k))

    def drop(self) -> None:
        self.last.clear()
        self.ticks.clear()


class Processes(Entities):
    """The process's values when it was last seen."""


class Adapters(Entities):
    """The adapter's values in the run's previous tick; none if it was not in it."""

    def values_before(self, value, previous):
        return super().values_before(value if value is not None and value[0] == previous else None, previous)


class Snapshots(Held):
    """Released snapshots after the one before, whose rows are marked."""

    def added(self) -> list[StructField]:
        return [StructField(EARLIER, BooleanType())]

    def keep(self, handle) -> None:
        self.last = handle.getListState("last", StructType([StructField(f.name, f.dataType) for f in self.schema.fields]))

    def looked_back(self, rows, final):
        at = self.names.index(self.at)
        yield from ((tuple(r), (True,)) for r in (self.last.get() if self.last.exists() else ()))
        yield from ((r, (False,)) for r in rows)
        if final:
            newest = max(r[at] for r in rows)
            self.last.put([r for r in rows if r[at] == newest])

    def drop(self) -> None:
        self.last.clear()


class Windows(Held):
    """Whole windows; they need nothing from before."""
