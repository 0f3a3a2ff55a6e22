"""p2: references to records that do not exist, as a fixpoint cascade over the foreign-key graph.

A reference is a *direct* orphan if no target row was in force when the reference came into force.
Children of orphans are *inherited* orphans: targets were in force, but each of them is itself an
orphan (direct or inherited). Direct orphans are found first, for all keys. Then the cascade goes down the graph
in rounds: the rows that became orphans in the last round are a frontier; a semi-join with it leaves the keys, another the references, whose
verdict may change, and only those are judged again, against the targets that are no orphans. It ends with the first empty frontier.
Every round but the last finds an orphan that was none before, so it ends on any graph, cycles included, without a limit.

"In force at that time" is no range join here. Targets and references of a key are one time line; a
target is in force at t exactly if the running maximum of the ends of all targets begun by t lies
after t. A time line is cut into days, and what earlier days hand on is pre-aggregated to one
row per key and day of targets. Where a key has more than ``CROWDED`` rows on a day, days are cut into hours, those into minutes and so on
down to microseconds, each level handing on to the next, so that no task sees a key whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import cut

START, END = -(2**63), 2**63 - 1
#: Lengths of the pieces a time line is cut into, in microseconds: day, hour, minute, second, millisecond, microsecond.
PIECES = (86_400_000_000, 3_600_000_000, 60_000_000, 1_000_000, 1_000, 1)
#: Rows of a key in one piece of its time line from which pieces are cut further.
CROWDED = 250_000


@dataclass(frozen=True)
class Entity:
    """A table. ``start``/``until``: columns of the times from and up to which a row is in force (none: always)."""

    name: str
    rows: DataFrame = field(compare=False)
    key: str = "id"
    start: str | None = None
    until: str | None = None


@dataclass(frozen=True)
class ForeignKey:
    """``columns`` of ``child`` name a row of ``parent`` by its ``target`` columns."""

    child: str
    columns: tuple[str, ...]
    parent: str
    target: tuple[str, ...]

    @property
    def name(self) -> str:
        return f"{self.child}({','.join(self.columns)})->{self.parent}"

    @property
    def keys(self) -> list[str]:
        return [f"k{i}" for i in range(len(self.columns))]


def _micros(column: str | None, default: int) -> str:
    return f"coalesce(unix_micros(`{column}`), {default}L)" if column else f"{default}L"


_START, _END = f"({START + 1}L - 1L)", f"{END}L"


class _Timeline:
    """All foreign keys that name the same columns of one parent: they share the time lines of its rows."""

    def __init__(self, table: dict[str, Entity], fks: Sequence[ForeignKey], numbers: Sequence[int]):
        self.fks, self.parent, self.keys = dict(zip(numbers, fks)), fks[0].parent, fks[0].keys
        parent = table[self.parent]
        start = f"coalesce(unix_micros(`{parent.start}`), {_START})" if parent.start else _START
        own = [f"`{c}` as {k}" for c, k in zip(fks[0].target, self.keys)]
        #: ``(row_id, keys, at, until)`` of the rows that can be referred to.
        self.targets = parent.rows.selectExpr(f"cast(`{parent.key}` as string) as row_id", *own, f"{start} as at", f"{_micros(parent.until, END)} as until").dropna(subset=self.keys)
        sides = []
        for number, fk in self.fks.items():
            child = table[fk.child]
            own = [f"`{c}` as {k}" for c, k in zip(fk.columns, self.keys)]
            sides.append(child.rows.selectExpr(f"{number} as fk", f"cast(`{child.key}` as string) as ref_id", *own, f"{_micros(child.start, END - 1)} as at").dropna(subset=[*self.keys, "ref_id"]))
        #: ``(fk, ref_id, keys, at)`` of the rows that refer to something.
        self.references = reduce(DataFrame.unionByName, sides)
        self.pieces: Sequence[int] = PIECES[:1]

    def cut_finely(self, crowded: int) -> None:
        """Finds the levels of pieces that leave no key with more than ``crowded`` rows in a piece: one count a level, of which one number comes to the driver."""
        both = self.targets.select(*self.keys, "at").unionByName(self.references.select(*self.keys, "at"))
        for level, length in enumerate(PIECES):
            self.pieces = PIECES[: level + 1]
            most = both.groupBy(*self.keys, F.expr(f"floor(at / {length})").alias("p")).count().agg(F.max("count")).first()[0]
            if most is None or most <= crowded:
                break


def _not_in_force(targets: DataFrame, references: DataFrame, keys: list[str], pieces: Sequence[int]) -> DataFrame:
    """The ``(fk, ref_id, at)`` for which no target was in force. Copies of rows are harmless on both sides."""
    names = [f"p{i}" for i in range(len(pieces))]
    piece = [f"floor(at / {length}L) as {name}" for length, name in zip(pieces, names)]
    nobody = ["cast(null as int) as fk", "cast(null as string) as ref_id"]
    starts = targets.selectExpr(*nobody, *keys, "at", "until", *piece)
    events = starts.union(references.selectExpr("fk", "ref_id", *keys, "at", "cast(null as bigint) as until", *piece))
    lines = events
    for level in range(len(pieces)):
        # what each piece hands on to the later ones within the piece above it
        own = [*keys, *names[: level + 1]]
        above = ", ".join(own[:-1])
        passed = events.groupBy(*own).agg(F.max("until").alias("until"))
        passed = passed.selectExpr(*own, f"max(until) over (partition by {above} order by {own[-1]} rows between unbounded preceding and 1 preceding) as until").where("until is not null")
        if level + 1 < len(pieces):  # to all the last pieces in it that have rows: an equi-join with one row a piece
            passed = events.select(*keys, *names).distinct().join(passed, own)
        lines = lines.union(passed.selectExpr(*nobody, *keys, f"{_START} as at", "until", *names))
    # targets sort before references of the same instant
    whole = ", ".join([*keys, *names])
    judged = lines.selectExpr("fk", "ref_id", "at", f"max(until) over (partition by {whole} order by at, ref_id nulls first rows between unbounded preceding and current row) as until")
    return judged.where("ref_id is not null and (until is null or until <= at)").select("fk", "ref_id", "at")


def orphan_cascade(entities: Sequence[Entity], fks: Sequence[ForeignKey], crowded: int = CROWDED) -> DataFrame:
    """``(ref_table, ref_id, fk, period, kind)``: one row per orphan reference; ``kind`` is direct or inherited,
    ``period`` the month (UTC, ``yyyy-MM``) in which the reference came into force.

    Null in a foreign key refers to nothing: never an orphan. Keys are compared exactly as stored.
    Null times: a target without start was always there, a reference without start is checked at the end of
    time (``period`` null). Copies of rows count once; empty tables are fine: without targets every reference is direct.
    The rounds run while the cascade is called; what they found is cut and returned.
    """
    table = {e.name: e for e in entities}
    groups: dict[tuple, list[int]] = {}
    for number, fk in enumerate(fks):
        groups.setdefault((fk.parent, fk.target), []).append(number)
    lines = [_Timeline(table, [fks[i] for i in numbers], numbers) for numbers in groups.values()]
    # a table's size tells whether its keys can be crowded at all
    sizes = {r["name"]: r["n"] for r in reduce(DataFrame.union, (table[n].rows.agg(F.count("*").alias("n")).selectExpr(f"'{n}' as name", "n") for n in dict.fromkeys(n for fk in fks for n in (fk.parent, fk.child)))).collect()}
    for line in lines:
        if sum(sizes[n] for n in {line.parent, *(fk.child for fk in line.fks.values())}) > crowded:
            line.cut_finely(crowded)
    direct = [_not_in_force(line.targets, line.references, line.keys, line.pieces) for line in lines]
    rounds = [cut(reduce(DataFrame.union, direct).distinct().withColumn("kind", F.lit("direct")))]
    parents = {line.parent for line in lines}
    of_table = {name: [i for i, fk in enumerate(fks) if fk.child == name] for name in parents}
    while True:
        # what became an orphan in the last round, though it was none before
        reached = {r[0] for r in rounds[-1].select("fk").distinct().collect()}
        found, inherited = reduce(DataFrame.union, rounds), []
        for line in lines:
            own = of_table[line.parent]
            if not reached & {*own}:
                continue
            rows = lambda df: df.where(F.col("fk").isin(*own)).select(F.col("ref_id").alias("row_id"))  # noqa: E731, B023
            new, known = rows(rounds[-1]), [rows(r) for r in rounds[:-1]]
            if known:
                new = new.join(reduce(DataFrame.union, known), "row_id", "left_anti")
            touched = line.targets.join(new, "row_id", "left_semi").select(*line.keys).distinct()
            sound = line.targets.join(touched, line.keys, "left_semi").join(rows(found), "row_id", "left_anti")
            told = found.where(F.col("fk").isin(*line.fks)).select("fk", "ref_id")
            asked = line.references.join(touched, line.keys, "left_semi").join(told, ["fk", "ref_id"], "left_anti").select("fk", "ref_id", *line.keys, "at")
            inherited.append(_not_in_force(sound, asked, line.keys, line.pieces))
        if not inherited:
            break
        rounds.append(cut(reduce(DataFrame.union, inherited).distinct().withColumn("kind", F.lit("inherited"))))
    names = {i: (fk.child, fk.name) for i, fk in enumerate(fks)}
    pick = lambda at: "case fk " + " ".join(f"when {i} then '{own[at]}'" for i, own in names.items()) + " end"
    month = f"case when at < {END - 1}L then date_format(timestamp_micros(at), 'yyyy-MM') end as period"
    return reduce(DataFrame.union, rounds).selectExpr(f"{pick(0)} as ref_table", "ref_id", f"{pick(1)} as fk", month, "kind")


def orphan_report(cascade: DataFrame) -> DataFrame:
    """``(ref_table, fk, period, direct, inherited)``: orphans per table, key and month."""
    return cascade.groupBy("ref_table", "fk", "period").agg(F.count_if(F.col("kind") == "direct").alias("direct"), F.count_if(F.col("kind") == "inherited").alias("inherited"))
