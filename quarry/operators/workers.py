"""Mappers and reducers in Python, kept in one registry by name.

Column expressions are the fast way to map and to aggregate; these classes are for
logic that needs them. A mapper lives through all passes over its partition. A reducer
sees each key once, in byte order: an incremental one folds values into a state, a batch
one walks over them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field


@dataclass
class Context:
    """What a worker may ask for, and where it emits."""

    shards: int = 1
    shard: int = 0
    passes: int = 1
    current_pass: int = 0
    map_only: bool = False
    input_format: str = "text"
    output_format: str = "text"
    config: dict = field(default_factory=dict)
    emitted: list = field(default_factory=list)

    def output(self, key, value) -> None:
        self.emitted.append((key, value, None))

    def output_to_shard(self, shard: int, key, value) -> None:
        if self.map_only:
            raise ValueError("a map-only job has no shards to send to")
        if not 0 <= shard < self.shards:
            raise ValueError(f"shard {shard} isn't one of {self.shards}")
        self.emitted.append((key, value, shard))

    def output_to_all_shards(self, key, value) -> None:
        if self.map_only:
            raise ValueError("a map-only job has no shards to send to")
        self.emitted.extend((key, value, shard) for shard in range(self.shards))


class Mapper:
    """start() and flush() are called once a pass over the partition, map() for each pair."""

    def __init__(self, context: Context):
        self.context = context

    def start(self) -> None: ...

    def map(self, key, value) -> None:
        raise NotImplementedError

    def flush(self) -> None: ...

    def shard(self, key, shards: int) -> int | None:
        """The shard of a key; None: by its hash."""
        return None


class IdentityMapper(Mapper):
    def map(self, key, value) -> None:
        self.context.output(key, value)


class Reducer:
    """start() and flush() are called once a shard."""

    def __init__(self, context: Context):
        self.context = context

    def start(self) -> None: ...

    def flush(self) -> None: ...


class IncrementalReducer(Reducer):
    def begin(self, key, value):
        """The state after a key's first value."""
        raise NotImplementedError

    def partial(self, key, value, state):
        """The state after one more value."""
        raise NotImplementedError

    def end(self, key, state) -> None:
        raise NotImplementedError


class BatchReducer(Reducer):
    def reduce(self, key, values: Iterator) -> Iterator | None:
        """May leave values unread; the rest of the key is then skipped.

        A generator is run to its end; at each yield, what was emitted may be handed over, so
        that a key's output is never held whole.
        """
        raise NotImplementedError


class IdentityReducer(BatchReducer):
    def reduce(self, key, values: Iterator) -> Iterator:
        for value in values:
            self.context.output(key, value)
            yield


class _Sum(IncrementalReducer):
    kind: Callable = int

    def begin(self, key, value):
        return self.kind(value)

    def partial(self, key, value, state):
        return state + self.kind(value)

    def end(self, key, state) -> None:
        self.context.output(key, repr(state) if isinstance(state, float) else str(state))


class SumInteger(_Sum):
    kind = int


class SumDouble(_Sum):
    kind = float


class SumFloat(_Sum):
    """Sums in single precision, value by value."""

    @staticmethod
    def kind(value):
        import numpy as np

        return np.float32(value)

    def end(self, key, state) -> None:
        self.context.output(key, str(state))


REGISTRY: dict[str, type] = {}


def register(name: str, kind: type | None = None):
    """Registers a class, as a call or a decorator; a second class of the same name is an error."""

    def add(given: type) -> type:
        if REGISTRY.setdefault(name, given) is not given:
            raise ValueError(f"{name} is taken")
        return given

    return add(kind) if kind else add


def create(name: str, context: Context, default: type | None = None):
    """An instance of a registered class, of the default where there is none of that name, else None."""
    kind = REGISTRY.get(name, default)
    return kind(context) if kind else None


for _kind in (IdentityMapper, IdentityReducer, SumInteger, SumFloat, SumDouble):
    register(_kind.__name__, _kind)
