"""p4: how often every term occurs, and in how many records, by recursive radix partitioning.

Rows go to disk partitions by the leading bits of a hash (Spark's shuffle files are those partitions): as many bits as leave a partition
half of ``CAP`` rows and ``CAP_BYTES``. One histogram shows the partitions that are larger all the same; those are split by further bits, again and again, until each fits or holds
one hash only. DuckDB then aggregates each partition by itself, within a fixed memory limit that follows from its bounds.

The leading half of the hash is that of a record, the other half that of a row. So all rows of a record meet in one partition, copies of a row
too, and its occurrences and records per term are final. Only a record of more than ``CAP`` rows is cut within, by the second half; what
its parts give goes through a second pass, by a hash of (term, record). No hash is of the term alone, so a term with a third of all rows is spread over all
partitions. The last sum per term is a plain aggregate of at most one row a term and partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.session import parallelism, staged

#: Most rows and bytes of terms and records in a partition, unless all rows have one hash (those are copies, which take no memory).
CAP, CAP_BYTES = 1_000_000, 64_000_000
#: Bits by which an oversized partition is split, and bits of the first histogram, of which at most ``2 ** FIRST`` counts come to the driver.
BITS, FIRST = 4, 12
MEMORY = "512MB"


@dataclass(frozen=True)
class Radix:
    """Partitions: ``2 ** bits`` by the leading bits; those of ``split``, as ``(level, prefix)``, are cut in ``2 ** BITS`` more each."""

    bits: int
    split: tuple[tuple[int, int], ...]

    @property
    def count(self) -> int:
        return 2**self.bits + 2**BITS * len(self.split)

    def leaf(self, hashed: Column) -> Column:
        """The number of a row's partition: arithmetic, but for the few that were split."""
        found = prefix_of(hashed, self.bits)
        for i, (level, prefix) in enumerate(self.split):  # outer ones come first, so inner ones win
            below = prefix_of(hashed, level + BITS).bitwiseAND(F.lit(2**BITS - 1))
            found = F.when(prefix_of(hashed, level) == prefix, F.lit(2**self.bits + 2**BITS * i) + below).otherwise(found)
        return found.cast("int")


    def beyond(self, level: int) -> list[int]:
        """The partitions that differ in bits after the first ``level``."""
        return [2**self.bits + 2**BITS * i + j for i, (at, _) in enumerate(self.split) if at + BITS > level for j in range(2**BITS)]


def prefix_of(hashed: Column, level: int) -> Column:
    return F.shiftrightunsigned(hashed, 64 - level) if level else F.lit(0).cast("long")


def radix(df: DataFrame, hashed: str, size: Column, cap: int = CAP, cap_bytes: int = CAP_BYTES) -> Radix:
    """The partitions of ``df`` by the 64-bit column ``hashed``; ``size``: bytes of a row. One pass gives the number of bits and what is oversized up to ``FIRST`` bits; each
    further level reads the oversized prefixes only, and returns only those that are oversized again."""

    def histogram(rows: DataFrame, level: int, only: bool) -> dict[int, tuple[int, int, bool]]:
        out = rows.groupBy(prefix_of(F.col(hashed), level).alias("p")).agg(F.count("*").alias("n"), F.sum(size).alias("b"), (F.min(hashed) == F.max(hashed)).alias("one"))
        out = out.where((F.col("n") > cap) | (F.col("b") > cap_bytes)) if only else out
        return {r["p"]: (r["n"], r["b"] or 0, r["one"]) for r in out.collect()}

    first = histogram(df, FIRST, False)
    rows, size_of = sum(n for n, _, _ in first.values()), sum(b for _, b, _ in first.values())
    least = math.ceil(math.log2(max(1, parallelism(df.sparkSession))))
    bits = max(least, math.ceil(math.log2(max(1.0, 2 * rows / cap, 2 * size_of / cap_bytes))))
    level = bits
    if bits <= FIRST:
        sums: dict[int, list] = {}
        for p, (n, b, one) in first.items():
            own = sums.setdefault(p >> (FIRST - bits), [0, 0, one, 0])
            own[0], own[1], own[3] = own[0] + n, own[1] + b, own[3] + 1
        over = {p: one and parts == 1 for p, (n, b, one, parts) in sums.items() if n > cap or b > cap_bytes}
    else:
        over = {p: one for p, (_, _, one) in histogram(df, bits, True).items()}
    split: list[tuple[int, int]] = []
    while over := {p: one for p, one in over.items() if not one}:
        split += [(level, p) for p in sorted(over)]
        inside = df.where(prefix_of(F.col(hashed), level).isin(*over))
        level += BITS
        if level + BITS > 64:
            break
        over = {p: one for p, (_, _, one) in histogram(inside, level, True).items()}
    return Radix(bits, tuple(split))


def _aggregate(whole: str, part: str | None, schema: pa.Schema):
    """mapInArrow body: one DuckDB query over each partition, streamed in and out; ``part`` for partitions marked as parts of a record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "preserve_insertion_order": False, "temp_directory": ""})
        try:
            first = next((b for b in batches if b.num_rows), None)
            if first is None:
                return
            con.register("arriving", pa.RecordBatchReader.from_batches(first.schema, _chain(first, batches)))
            sql = part if part and first.column("part")[0].as_py() else whole
            for batch in con.sql(sql).to_arrow_reader(50_000):
                yield pa.record_batch([c.cast(t) for c, t in zip(batch.columns, schema.types)], schema=schema)
        finally:
            con.close()

    return run


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_ROWS = "WITH r AS MATERIALIZED (SELECT DISTINCT term, record, r1, r2 FROM arriving), t AS MATERIALIZED (SELECT term, record, count(*) AS n FROM r GROUP BY ALL) "
# a line without a term counts the records
_WHOLE = _ROWS + "SELECT term, NULL AS record, sum(n) AS occurrences, count(*) AS records FROM t WHERE term IS NOT NULL GROUP BY term UNION ALL SELECT NULL, NULL, 0, count(DISTINCT record) FROM t"
_PART = _ROWS + "SELECT term, record, n, NULL FROM t UNION ALL SELECT NULL, record, 0, NULL FROM t WHERE term IS NOT NULL GROUP BY record"
_AGAIN = "WITH r AS MATERIALIZED (SELECT term, record, sum(occurrences) AS n FROM arriving GROUP BY ALL) SELECT term, NULL, sum(n), count(*) FROM r GROUP BY term"


def term_counts(rows: DataFrame, term: Column, record: list[str], *, cap: int = CAP) -> DataFrame:
    """``(term, occurrences, records)`` of each non-null ``term`` over distinct ``rows``; the row with a null term has, as
    ``records``, the number of all records. ``record``: the columns that name a record (null is a value like any other).
    Equal rows count once (told apart by their record and 128 bits of hashes); an empty table gives no rows at all."""
    text = lambda c: f"coalesce(concat('=', cast(`{c}` as string)), '!')"
    whole = ", ".join(map(text, rows.columns))
    slim = rows.select(term.alias("term"), F.expr(f"concat_ws('\x1f', {', '.join(map(text, record))})").alias("record"), F.expr(f"xxhash64({whole})").alias("r1"), F.expr(f"xxhash64('second', {whole})").alias("r2"))
    slim = slim.withColumn("h", F.expr("shiftleft(shiftrightunsigned(xxhash64(record), 32), 32) | shiftrightunsigned(r1, 32)"))
    size = F.octet_length("record") + F.coalesce(F.octet_length("term"), F.lit(0)) + 32
    schema = pa.schema([("term", pa.string()), ("record", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    ddl = "term string, record string, occurrences long, records long"

    def parted(df: DataFrame, parts: Radix) -> DataFrame:
        cut_within = parts.beyond(32)
        leaf = df.withColumn("leaf", parts.leaf(F.col("h"))).drop("h")
        leaf = leaf.withColumn("part", F.col("leaf").isin(*cut_within) if cut_within else F.lit(False))
        return leaf.repartitionById(parts.count, F.col("leaf")).drop("leaf")

    parts = radix(slim, "h", size, cap)
    counts = parted(slim, parts).mapInArrow(_aggregate(_WHOLE, _PART, schema), ddl)
    if parts.beyond(32):
        counts = staged(counts)
        again = counts.where("record is not null").select("term", "record", "occurrences", F.xxhash64("term", "record").alias("h"))
        second = parted(again, Radix(radix(again, "h", size, cap).bits, ())).mapInArrow(_aggregate(_AGAIN, None, schema), ddl)
        counts = counts.where("record is null").union(second)
    return staged(counts.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")))


def marked(counts: DataFrame, rare_below: int = 3, common_share: float = 0.08) -> DataFrame:
    """``(term, occurrences, records, mark)``: ``rare`` in fewer than ``rare_below`` records, ``common`` in at least
    ``common_share`` of all records, else null. With few records a term can be both: then there is a row for each mark.
    The number of all records is a scalar subquery."""
    total = counts.where("term is null").agg(F.coalesce(F.sum("records"), F.lit(0)).alias("total")).scalar()
    terms = counts.where("term is not null").withColumn("total", total)
    marks = F.array_compact(F.array(F.when(F.col("records") < rare_below, "rare"), F.when(F.col("records") >= F.col("total") * common_share, "common")))
    return terms.select("term", "occurrences", "records", F.explode_outer(marks).alias("mark"))
