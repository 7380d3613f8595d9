"""A source behind a search with a ceiling, read whole: its partitions come from a plan that the source's own totals make.

A search never shows more than ``cap`` rows, however many it finds, but says how many those are. The planner asks for
the total of a slice and, while that is over the cap, divides the slice along its next free dimension: subcategories,
price bands and their halves, then one facet after another. Every slice that fits is fetched page by page inside a
task; slices share a partition, which holds no more than ``cap`` rows either as long as there are few, and up to
``PACK`` times as many in a large source, page by page. Rows already held play no part.

Slices of one level are asked for side by side, so a plan takes as many rounds as the deepest slice has cuts, and a
cut costs as many questions as it has parts. ``spread_plan`` has Spark's tasks ask them, and only totals come back to the
driver; ``plan`` asks from where it runs and keeps the first pages. Parts must make up the whole: a category is only divided where its
children's counts add up to its own, prices are half-open ranges with a slice of their own for rows without a price,
and what the parts of a slice lack (facet values that nobody listed, ends where no dimension is left) is counted as
``missing``; a reader refuses a plan that misses more than it was told to accept.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from functools import lru_cache
from typing import TYPE_CHECKING

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..rules.tables import PRICE_BANDS

if TYPE_CHECKING:
    import pyarrow as pa

CAP, PAGE, DEPTH = 500, 50, 8
#: Partitions of a read at least before one holds more than ``cap`` rows, how many times ``cap`` rows it holds at most,
#: rows that a reader hands on at a time, and row groups that a process of a recorded source holds.
PARTS, PACK, HANDED, HELD = 256, 64, 10_000, 16


@dataclass(frozen=True)
class Slice:
    """What to search for: a category, prices from ``low`` to below ``high`` (``priced`` false: rows without a price),
    and values of facets."""

    category: str | None = None
    low: int | None = None
    high: int | None = None
    priced: bool | None = None
    facets: tuple[tuple[str, str], ...] = ()


@dataclass
class Answer:
    """One page of a search: its records, as a list or a table, how many rows match in all, and the subcategories with
    their counts."""

    records: list[dict] | pa.Table
    total: int
    children: list[tuple[str, int]] = field(default_factory=list)


#: ``search(slice, page)``; pages count from 1, and those beyond the ceiling are empty. Page 0, which only
#: ``spread_plan`` asks for, has no records.
Search = Callable[[Slice, int], Answer]


@dataclass
class Plan:
    leaves: list[tuple[Slice, Answer]]
    probes: int
    missing: int


def bands(low: int | None, high: int | None, seeds: tuple[int, ...] = PRICE_BANDS) -> list[tuple[int, int | None]] | None:
    """Parts of a price range; None if it is a single price."""
    if low is None:
        return list(zip(seeds, [*seeds[1:], None]))
    middle = max(2 * low, low + 1) if high is None else (low + high) // 2
    return [(low, middle), (middle, high)] if middle > low and (high is None or middle < high) else None


def parts(s: Slice, answer: Answer, depth: int, seen: set[str], facets: dict[str, list[str]]) -> list[Slice]:
    """The slices that a slice over the cap is divided into, none if there is no dimension left."""
    if s.low is None and s.priced is None and depth < DEPTH:
        new = [(c, n) for c, n in answer.children if n and c not in seen]
        if new and sum(n for _, n in new) == answer.total:
            seen.update(c for c, _ in new)
            return [replace(s, category=c) for c, _ in new]
    if s.priced is not False and (ranges := bands(s.low, s.high)):
        priced = [replace(s, low=a, high=b, priced=True) for a, b in ranges]
        return priced if s.priced else [*priced, replace(s, priced=False)]
    for name, values in facets.items():
        if name not in dict(s.facets):
            return [replace(s, facets=(*s.facets, (name, v))) for v in values]
    return []


def plan(search: Search, facets: dict[str, list[str]], cap: int = CAP, roots: list[str] | None = None, width: int = 16, max_probes: int | None = None) -> Plan:
    """Slices of at most ``cap`` rows that make up the source, or the categories ``roots`` of it."""
    with ThreadPoolExecutor(width) as pool:
        return _plan(lambda level: list(pool.map(lambda s: search(s, 1), level)), facets, cap, roots, max_probes)


def spread_plan(spark: SparkSession, search: Search, facets: dict[str, list[str]], cap: int = CAP, roots: list[str] | None = None, max_probes: int | None = None) -> Plan:
    """The plan of ``plan``, its questions dealt over the cluster, without records."""
    context = spark.sparkContext

    def ask(level: list[Slice]) -> list[Answer]:
        tasks = min(len(level), 4 * context.defaultParallelism)
        return context.parallelize(level, tasks).map(lambda s: search(s, 0)).collect()

    return _plan(ask, facets, cap, roots, max_probes)


def _plan(ask: Callable[[list[Slice]], list[Answer]], facets: dict[str, list[str]], cap: int, roots: list[str] | None, max_probes: int | None) -> Plan:
    found, seen = Plan([], 0, 0), set(roots or [])
    level = [(Slice(category=c), 0) for c in roots or [None]]
    while level:
        if max_probes is not None and found.probes + len(level) > max_probes:
            raise ValueError(f"the plan needs more than {max_probes} searches")
        answers = ask([s for s, _ in level])
        found.probes += len(level)
        below: list[tuple[Slice, int]] = []
        for (s, depth), answer in zip(level, answers):
            found.missing -= answer.total if depth else 0  # its parent's total was added
            if answer.total > cap and (cut := parts(s, answer, depth, seen, facets)):
                found.missing += answer.total
                below += [(c, depth + 1) for c in cut]
            elif answer.total:
                found.leaves.append((s, answer))
                found.missing += max(answer.total - cap, 0)
        level = below
    return found


class Leaf(InputPartition):
    def __init__(self, what: Slice, answer: Answer) -> None:
        super().__init__(what)
        self.what, self.total, self.records = what, answer.total, answer.records


class Leaves(InputPartition):
    """Leaves that one task reads."""

    def __init__(self, leaves: list[Leaf]) -> None:
        super().__init__([leaf.what for leaf in leaves])
        self.leaves = leaves


class _Sliced(DataSourceReader):
    def __init__(self, search: Search, facets: dict[str, list[str]], names: list[str], cap: int, accept: float, roots: list[str] | None, planned: Plan | None = None) -> None:
        self.search, self.facets, self.names, self.cap, self.accept, self.roots, self.planned = search, facets, names, cap, accept, roots, planned

    def partitions(self) -> list[InputPartition]:
        found = self.planned or plan(self.search, self.facets, self.cap, self.roots)
        whole = sum(a.total for _, a in found.leaves)
        if found.missing > self.accept * whole:
            raise ValueError(f"{found.missing} of {whole + found.missing} rows are out of the search's reach")
        packs: list[list[Leaf]] = []
        room, most = 0, max(self.cap, min(whole // PARTS, PACK * self.cap))
        for leaf in (Leaf(s, a) for s, a in found.leaves):
            if leaf.total > room:
                packs.append([])
                room = most
            packs[-1].append(leaf)
            room -= leaf.total
        self.planned = None  # a task needs its own leaves only
        return [Leaves(pack) for pack in packs]

    def read(self, partition: Leaf | Leaves) -> Iterator[tuple | pa.RecordBatch]:
        held, n = [], 0  # pages that are tables are handed on many at a time
        for leaf in partition.leaves if isinstance(partition, Leaves) else [partition]:
            for records in self._pages(leaf):
                if isinstance(records, list):
                    yield from (tuple(record.get(n) for n in self.names) for record in records)
                    continue
                held.append(records.select(self.names))
                n += len(records)
                if n >= HANDED:
                    yield from _joined(held)
                    held, n = [], 0
        yield from _joined(held)

    def _pages(self, partition: Leaf) -> Iterator[list[dict] | pa.Table]:
        page, left = 1, min(partition.total, self.cap)
        records = partition.records or (self.search(partition.what, 1).records if left else [])
        while records and left > 0:
            yield records
            left -= len(records)
            page += 1
            records = self.search(partition.what, page).records if left > 0 else []


def _joined(tables: list[pa.Table]) -> list[pa.RecordBatch]:
    import pyarrow as pa

    return pa.concat_tables(tables).combine_chunks().to_batches() if tables else []


def register_sliced(spark: SparkSession, name: str, schema: str, search: Search, facets: dict[str, list[str]], cap: int = CAP, accept: float = 0.0, roots: list[str] | None = None, planned: Plan | None = None) -> None:
    """Registers format ``name`` for spark.read, by a plan if one is ``planned``. ``search`` must be picklable. With a live source, whose totals move
    between two questions, let ``accept`` be the share of rows that may be missing."""
    names = StructType.fromDDL(schema).names

    class Sliced(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: StructType) -> DataSourceReader:
            return _Sliced(search, facets, names, cap, accept, roots, planned)

    spark.dataSource.register(Sliced)


class _Groups:
    """The row groups of a recorded source with what their footers tell: rows, and the least and greatest ``main``,
    ``category`` and ``price``, by which a question finds the few that it has to read."""

    def __init__(self, uri: str) -> None:
        import numpy as np
        import pyarrow.dataset as ds
        import pyarrow.fs as pf

        system, path = pf.FileSystem.from_uri(uri) if ":" in uri else (pf.LocalFileSystem(), uri)
        self.schema = ds.dataset(path, filesystem=system, format="parquet").schema
        self.fragments, told = [], []
        for f in ds.dataset(path, filesystem=system, format="parquet").get_fragments():
            f.ensure_complete_metadata()
            for g in f.row_groups:
                of = g.statistics
                self.fragments.append(f.subset(row_group_ids=[g.id]))
                told.append((g.num_rows, *[(of[n]["min"], of[n]["max"]) if n in of and of[n]["min"] is not None else None for n in ("main", "category", "price")]))
        self.rows = np.array([n for n, *_ in told], np.int64)
        self.names, self.spans = {}, {}  # values in order, and places of the least and greatest among them
        for i, name in enumerate(("main", "category"), 1):
            self.names[name] = sorted({x for row in told if row[i] for x in row[i]})
            at = {x: k for k, x in enumerate(self.names[name])}
            self.spans[name] = np.array([(at[row[i][0]], at[row[i][1]]) if row[i] else (-1, len(at)) for row in told], np.int64).reshape(-1, 2)
        self.price = np.array([row[3] or (np.iinfo(np.int64).min, np.iinfo(np.int64).max) for row in told], np.int64).reshape(-1, 2)

    def able(self, s: Slice) -> list[int]:
        """Row groups that may hold rows of a slice."""
        import numpy as np

        may = np.ones(len(self.rows), bool)
        if s.category is not None:
            may = self._spans("main", s.category) | self._spans("category", s.category)
        if s.low is not None:
            may &= self.price[:, 1] >= s.low
        if s.high is not None:
            may &= self.price[:, 0] < s.high
        return np.flatnonzero(may).tolist()

    def _spans(self, name: str, value: str):
        low, high = bisect_left(self.names[name], value), bisect_right(self.names[name], value) - 1
        return (self.spans[name][:, 0] <= high) & (self.spans[name][:, 1] >= low)


@lru_cache(maxsize=4)
def _groups(uri: str) -> _Groups:
    return _Groups(uri)


@lru_cache(maxsize=HELD)
def _held(uri: str, i: int, columns: tuple[str, ...] | None = None):
    """Columns of a row group, by default all, read once while questions about it follow one another."""
    return _groups(uri).fragments[i].to_table(columns=columns and list(columns), use_threads=False).combine_chunks()


@lru_cache(maxsize=4)
def _shown(source: Recorded, s: Slice) -> tuple:
    """(rows that a search shows, how many it finds)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    best, total = None, 0
    first = lambda t: t.take(pc.sort_indices(t, [(source.key, "ascending")])[: source.cap])
    for part in source.found(s):
        total += part.num_rows
        best = first(pa.concat_tables([best, part]) if best is not None else part)
    return best, total


@dataclass(frozen=True)
class Recorded:
    """A search over a recorded source: Parquet with the rows' own columns and ``main``, ``category`` and ``price``,
    written once, best in the order of category and price. Like the service it shows ``cap`` rows at most, in the order
    of ``key``. A search reads the row groups that may hold its category and prices, one after another; its records are
    a table."""

    path: str
    key: str
    page: int = PAGE
    cap: int = CAP

    def found(self, s: Slice) -> Iterator:
        """Tables of what a slice holds, none of them empty."""
        for i in _groups(self.path).able(s):
            rows = _held(self.path, i)
            rule = _rule(rows, s)
            if (rows := rows if rule is None else rows.filter(rule)).num_rows:
                yield rows

    def _counted(self, s: Slice, below: str | None) -> tuple[int, dict[str, int]]:
        """How many rows a slice holds, and of each value of ``below``."""
        import pyarrow.compute as pc

        total, children = 0, {}
        columns = ("main", *["category"] * (s.category is not None), *["price"] * (s != replace(s, low=None, high=None, priced=None)), *[n for n, _ in s.facets])
        for i in _groups(self.path).able(s):
            rows = _held(self.path, i, columns)
            rule = _rule(rows, s)
            if below is None:
                total += rows.num_rows if rule is None else pc.sum(rule).as_py() or 0
                continue
            rows = rows if rule is None else rows.filter(rule)
            total += rows.num_rows
            for r in rows[below].value_counts().to_pylist():
                children[r["values"]] = children.get(r["values"], 0) + r["counts"]
        children.pop(None, None)
        return total, children

    def __call__(self, s: Slice, page: int) -> Answer:
        below = "main" if s.category is None else "category" if "/" not in s.category else None
        if page < 1:
            total, children = self._counted(s, below)
            return Answer([], total, sorted(children.items()))
        children = self._counted(s, below)[1] if page == 1 and below is not None else {}
        rows, total = _shown(self, s)
        first = (page - 1) * self.page
        return Answer(rows.slice(first, max(0, min(self.page, self.cap - first))) if rows is not None else [], total, sorted(children.items()))


def _rule(rows, s: Slice):
    """Which rows a slice holds, None for all."""
    import pyarrow.compute as pc

    wanted = [pc.equal(rows[n], v) for n, v in s.facets]
    if s.category is not None:
        wanted.append(pc.or_kleene(pc.equal(rows["category"], s.category), pc.equal(rows["main"], s.category)))
    if s.priced is not None:
        wanted.append(rows["price"].is_valid() if s.priced else rows["price"].is_null())
    if s.low is not None:
        wanted.append(pc.greater_equal(rows["price"], s.low))
    if s.high is not None:
        wanted.append(pc.less(rows["price"], s.high))
    rule = None
    for w in wanted:
        rule = w if rule is None else pc.and_kleene(rule, w)
    return rule
