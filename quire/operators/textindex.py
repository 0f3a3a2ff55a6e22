"""K: full-text search over any table with a row id and a text.

A row's *hits* are the positions of each query term in it; they come from a scan of the text (everything stays in one
projection, no shuffle) or from stored postings (only those of the query's terms are read). Matching, phrase frequencies and
BM25 are Column arithmetic over hits. Statistics (rows, average length, rows per phrase) are of the whole index, whatever is
filtered later. Pages are ranked first; snippets are made for the rows of the page only.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.textquery import And, Near, Not, Or, Phrase, latin_folds, parse, phrases_of, tokenize

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
OPEN, CLOSE, GAP, WINDOW = "<mark>", "</mark>", "…", 32


def tokens(text: Column) -> Column:
    """The tokens of a text as an array; null has none."""
    return F.coalesce(F.regexp_extract_all(F.lower(F.translate(text, *latin_folds())), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0)), F.array().cast("array<string>"))


def postings(rows: DataFrame, row_id: str, text: str) -> DataFrame:
    """K1: ``(term, row_id, positions, length)``, clustered by term when written; ``length`` is that of the row."""
    split = rows.select(F.col(row_id).alias("row_id"), tokens(F.col(text)).alias("t"))
    words = split.select("row_id", F.size("t").alias("length"), F.posexplode("t").alias("position", "term"))
    return words.groupBy("term", "row_id").agg(F.array_sort(F.collect_list("position")).alias("positions"), F.any_value("length").alias("length"))


def corpus_stats(rows: DataFrame, text: str) -> DataFrame:
    """K1: one row ``(n, avg_length)``; of an empty table ``(0, null)``."""
    return rows.select(F.size(tokens(F.col(text))).alias("l")).agg(F.count("*").alias("n"), F.avg("l").alias("avg_length"))


@dataclass(frozen=True)
class Scored:
    """``rows``: matching rows with their columns and ``score`` (higher is better). ``stats``: one row over the whole index."""

    rows: DataFrame
    stats: DataFrame


def _terms(tree) -> list[tuple[str, bool]]:
    """Distinct ``(term, is prefix)`` of a tree."""
    return list(dict.fromkeys((t, p.prefix and i == len(p.terms) - 1) for p in phrases_of(tree) for i, t in enumerate(p.terms)))


def _positions(tok: Column, term: str, prefix: bool) -> Column:
    """Positions (from 0) of a term among tokens."""
    at = F.transform(tok, lambda t, i: F.when(t.startswith(term) if prefix else t == term, i))
    return F.array_compact(at)


def _instances(phrase: Phrase, hit: dict[tuple[str, bool], Column]) -> Column:
    """Start positions of a phrase."""
    last = len(phrase.terms) - 1
    arrays = [hit[t, phrase.prefix and i == last] for i, t in enumerate(phrase.terms)]
    if not arrays:
        return F.array().cast("array<int>")
    follows = [(i, a) for i, a in enumerate(arrays) if i]
    found = arrays[0]
    if follows:
        found = F.filter(found, lambda p: reduce(and_, (F.array_contains(a, p + i) for i, a in follows)))
    return F.filter(found, lambda p: p == 0) if phrase.first else found


def _near(node: Near, starts: list[Column]) -> list[Column]:
    """Of each phrase, the starts that lie in a clump with all others: from the end of its first phrase to the start of its last
    phrase at most ``distance`` tokens."""
    if len(starts) == 1:
        return starts

    def clump(first: int, s: Column, i: int, p: Column) -> Column:
        upto = s + (len(node.phrases[first].terms) + node.distance)
        rest = [F.exists(a, lambda q: (q >= s) & (q <= upto)) for j, a in enumerate(starts) if j not in (i, first)]
        own = p == s if i == first else (p >= s) & (p <= upto)
        return reduce(and_, rest, own)

    def any_first(i: int, p: Column, k: int) -> Column:
        return F.exists(starts[k], lambda s: clump(k, s, i, p))

    def kept(i: int) -> Column:
        return F.filter(starts[i], lambda p: reduce(or_, (any_first(i, p, k) for k in range(len(starts)))))

    return [kept(i) for i in range(len(starts))]


def _walk(node, names: dict[int, str], at: list[int]) -> tuple[Column, list[tuple[int, Column]]]:
    """``(matches, [(phrase number, counts for the score)])`` over columns with phrase frequencies. A phrase counts only if the AND or
    NEAR groups it stands in matched; what follows NOT never counts."""
    if isinstance(node, Near):
        own = []
        for p in node.phrases:
            own.append(at[0])
            at[0] += 1
        fine = reduce(and_, (F.col(names[i]) > 0 for i, p in zip(own, node.phrases) if p.terms), F.lit(any(p.terms for p in node.phrases)))
        return fine, [(i, fine) for i in own]
    if isinstance(node, Not):
        keep, active = _walk(node.keep, names, at)
        drop, _ = _walk(node.drop, names, at)
        fine = keep & ~drop
        return fine, [(i, a & fine) for i, a in active]
    parts = [_walk(p, names, at) for p in node.parts]
    if isinstance(node, Or):
        return reduce(or_, (m for m, _ in parts)), [x for _, a in parts for x in a]
    fine = reduce(and_, (m for m, _ in parts))
    return fine, [(i, a & fine) for _, active in parts for i, a in active]


def _groups(node) -> list[Near]:
    if isinstance(node, Near):
        return [node]
    return _groups(node.keep) + _groups(node.drop) if isinstance(node, Not) else [g for p in node.parts for g in _groups(p)]


def scored(rows: DataFrame, text: str, query: str, *, hits: DataFrame | None = None) -> Scored:
    """K6 and K7: the rows that match, with ``score``.

    ``rows`` is the whole index; with ``hits`` (see :func:`hits_from_postings`) its texts are not read again.
    Null texts match nothing and count as rows of length 0. A query without any token matches nothing.
    """
    tree = parse(query)
    wanted = _terms(tree)
    if hits is None:
        base = rows.withColumn("_t", tokens(F.col(text)))
        base = base.select(*rows.columns, F.size("_t").alias("_length"), *(_positions(F.col("_t"), t, p).alias(f"_h{i}") for i, (t, p) in enumerate(wanted)))
    else:
        base = hits
    base, number = _phrase_counts(base, tree, wanted)
    stats = base.agg(F.count("*").alias("n"), F.avg("_length").alias("avg_length"), *(F.count_if(F.col(f"_a{i}") > 0).alias(f"df{i}") for i in range(number)))
    return Scored(_rated(base, tree, number, stats).select(*rows.columns, "score"), stats)


def _rated(base: DataFrame, tree, number: int, stats: DataFrame) -> DataFrame:
    """The rows of ``base`` (with frequencies ``_f0``, ... and ``_length``) that match, with ``score``; ``stats`` is read as one scalar subquery."""
    matched, active = _walk(tree, {i: f"_f{i}" for i in range(number)}, [0])
    whole = stats.select(F.struct(*(F.col(c).cast("double").alias(c) for c in stats.columns)).alias("s")).scalar()

    def part(i: int, counts: Column) -> Column:
        n, df, avg = whole["n"], whole[f"df{i}"], whole["avg_length"]
        idf = F.greatest(F.ln((n - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_f{i}").cast("double")
        return F.when(counts & (f > 0), idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("_length") / avg))).otherwise(0.0)

    return base.where(matched).withColumn("score", reduce(lambda a, b: a + b, (part(i, c) for i, c in active), F.lit(0.0)))


def _phrase_counts(base: DataFrame, tree, wanted: list[tuple[str, bool]]) -> tuple[DataFrame, int]:
    """``base`` with hits ``_h0``, ... as frequencies: ``_f`` of each phrase that counts, ``_a`` of each phrase alone; and how many there are."""
    hit = {key: F.col(f"_h{i}") for i, key in enumerate(wanted)}
    number, frequencies, alone = 0, [], []
    for group in _groups(tree):
        starts = [_instances(p, hit) for p in group.phrases]
        for whole, near in zip(starts, _near(group, starts)):
            frequencies.append(F.size(near).alias(f"_f{number}"))
            alone.append(F.size(whole).alias(f"_a{number}"))
            number += 1
    return base.select(*[c for c in base.columns if not c.startswith("_h")], *frequencies, *alone), number


# -- stored indexes -------------------------------------------------------------------
@dataclass(frozen=True)
class Index:
    """``postings(term, row, positions, length, ...)``, a row a term and text, clustered by term, with the columns results are filtered and
    ordered by; ``stats``: one row ``(n, avg_length)``."""

    postings: DataFrame
    stats: DataFrame
    columns: tuple[str, ...]

    def scored(self, query: str) -> Scored:
        """K6 and K7 from the postings of the query's terms: no text is read, and only the row groups of those terms."""
        tree = parse(query)
        wanted = _terms(tree)
        is_term = lambda t, p: F.col("term").startswith(t) if p else F.col("term") == t
        own = self.postings.where(reduce(or_, (is_term(t, p) for t, p in wanted), F.lit(False)))
        hits = [F.array_sort(F.flatten(F.collect_list(F.when(is_term(t, p), F.col("positions"))))).alias(f"_h{i}") for i, (t, p) in enumerate(wanted)]
        base = own.groupBy("row", *self.columns, F.col("length").alias("_length")).agg(*(hits or [F.count("*").alias("_h")]))
        base, number = _phrase_counts(base, tree, wanted)
        found = base.agg(F.count("*").alias("found"), *(F.count_if(F.col(f"_a{i}") > 0).alias(f"df{i}") for i in range(number)))
        stats = found.withColumns({c: self.stats.select(c).scalar() for c in ("n", "avg_length")})
        return Scored(_rated(base, tree, number, stats).select(*self.columns, "score"), stats)


def build_index(rows: DataFrame, text: str, folder: str) -> None:
    """Writes the postings and statistics of ``rows`` (each counts once) to ``folder``. Rows are spread by term and text, so that a term that is everywhere is
    split over files."""
    from quire.sources.sinks import write_table

    columns = [c for c in rows.columns if c != text]
    own = rows.distinct()
    split = own.select(F.xxhash64(*rows.columns).alias("row"), *columns, tokens(F.col(text)).alias("t"))
    words = split.select("row", *columns, F.size("t").alias("length"), F.posexplode("t").alias("position", "term"))
    postings = words.groupBy("term", "row", *columns, "length").agg(F.array_sort(F.collect_list("position")).alias("positions"))
    write_table(postings, folder, "postings", cluster=["term", "row"])
    write_table(corpus_stats(own, text), folder, "stats")


def open_index(spark: SparkSession, folder: str) -> Index:
    postings = spark.read.parquet(f"{folder}/postings.parquet")
    return Index(postings, spark.read.parquet(f"{folder}/stats.parquet"), tuple(c for c in postings.columns if c not in ("term", "row", "positions", "length")))


def hits_from_postings(rows: DataFrame, row_id: str, index: DataFrame, query: str) -> DataFrame:
    """Hits of a query from stored postings: only rows of the query's terms are read (the filter on ``term`` is pushed down). ``rows``
    carries the columns to keep and, as ``_length``, the lengths of all rows."""
    wanted = _terms(parse(query))
    if not wanted:
        wanted_filter = F.lit(False)
    else:
        wanted_filter = reduce(or_, (F.col("term").startswith(t) if p else F.col("term") == t for t, p in wanted))
    own = index.where(wanted_filter).groupBy(F.col("row_id").alias(row_id)).agg(
        *(F.array_sort(F.flatten(F.collect_list(F.when(F.col("term").startswith(t) if p else F.col("term") == t, F.col("positions"))))).alias(f"_h{i}") for i, (t, p) in enumerate(wanted))
    )
    empty = F.array().cast("array<int>")
    joined = rows.join(own, row_id, "left")
    return joined.select(*rows.columns, *(F.coalesce(F.col(f"_h{i}"), empty).alias(f"_h{i}") for i in range(len(wanted))))


def ranked(found: DataFrame, *order: Column, limit: int, offset: int = 0) -> DataFrame:
    """H3: a page by score (rounded to 9 digits, so that ties are ties on any plan), then ``order``."""
    return found.orderBy(F.desc(F.round("score", 9)), *order).offset(offset).limit(limit)


def best_by_key(found: DataFrame, key: list[str]) -> DataFrame:
    """K3: one row a key with its best score and how many rows matched."""
    return found.groupBy(*key).agg(F.max("score").alias("score"), F.count("*").alias("n_matches"))


# -- snippets ----------------------------------------------------------------------
def snippet_text(text: str, query: str, window: int = WINDOW) -> str:
    """K8: the best window of ``window`` tokens, hits marked. Each candidate window starts at a hit (centred on what it
    covers) or at the sentence before it; a phrase's first hit in a window counts 1000, a further one 1, a start of the text
    120, of a sentence 100."""
    tree = parse(query)
    spans = _token_spans(text)
    words = [w for w, _, _ in spans]
    n = len(words)
    _, hits = _hits(tree, words, [0])
    hits.sort()
    if not n:
        return text

    def score(at: int) -> tuple[int, int]:
        got, seen, low, high = 0, set(), None, 0
        for s, k, size in hits:
            if at <= s < at + window:
                got += 1 if k in seen else 1000
                seen.add(k)
                low = s if low is None else low
                high = s + size
        low = 0 if low is None else low
        moved = low - int((window - (high - low)) / 2)
        return got, max(min(moved, n - window), 0)

    best, start = -1, 0
    heads = [0] + [i for i in range(1, n) if _opens_sentence(text, spans[i][1])]
    for s, _, _ in hits:
        got, moved = score(s)
        if got > best:
            best, start = got, moved
        if n > window:
            head = max(h for h in heads if h <= s)
            if head < s:
                got = score(head)[0] + (120 if head == 0 else 100)
                if got > best:
                    best, start = got, head
    stop = min(start + window, n) - 1
    merged: list[list[int]] = []
    for s, _, size in hits:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s + size - 1)
        else:
            merged.append([s, s + size - 1])
    at = spans[start][1] if start else 0
    end = len(text) if stop == n - 1 else spans[stop][2]
    out = [GAP] if start else []
    for a, b in merged:
        if not start <= a <= stop:
            continue
        b = min(b, stop)  # a hit that the window cuts is marked up to there
        out += [text[at : spans[a][1]], OPEN, text[spans[a][1] : spans[b][2]], CLOSE]
        at = spans[b][2]
    out.append(text[at:end])
    return "".join(out) + (GAP if stop < n - 1 else "")


def _opens_sentence(text: str, at: int) -> bool:
    before = text[:at]
    bare = before.rstrip(" \t\n\r")
    return len(bare) < len(before) and bare.endswith((".", ":"))


def _token_spans(text: str) -> list[tuple[str, int, int]]:
    import re

    return [(tokenize(m[0])[0], m.start(), m.end()) for m in re.finditer(r"(?:[^\W_]|[\ue000-\uf8ff])+", text) if tokenize(m[0])]


def _hits(node, words: list[str], number: list[int]) -> tuple[bool, list[tuple[int, int, int]]]:
    """Whether a row matches, and ``(start, phrase number, length)`` of the phrases that count in it."""
    if isinstance(node, Near):
        starts = [_starts_in(words, p) for p in node.phrases]
        if len(starts) > 1:
            size = [len(p.terms) for p in node.phrases]
            clumps = [(s, s + size[k] + node.distance) for k, own in enumerate(starts) for s in own]
            clumps = [(a, b) for a, b in clumps if all(any(a <= x <= b for x in own) for own in starts)]
            starts = [[x for x in own if any(a <= x <= b for a, b in clumps)] for own in starts]
        first = number[0]
        number[0] += len(starts)
        fine = all(own for own, p in zip(starts, node.phrases) if p.terms) and any(p.terms for p in node.phrases)
        return fine, [(s, first + k, len(p.terms)) for k, (own, p) in enumerate(zip(starts, node.phrases)) for s in own] if fine else []
    if isinstance(node, Not):
        keep, hits = _hits(node.keep, words, number)
        drop, _ = _hits(node.drop, words, number)
        return keep and not drop, hits if keep and not drop else []
    parts = [_hits(p, words, number) for p in node.parts]
    fine = any(m for m, _ in parts) if isinstance(node, Or) else all(m for m, _ in parts)
    return fine, [h for _, own in parts for h in own] if fine else []


def _starts_in(words: list[str], phrase: Phrase) -> list[int]:
    size = len(phrase.terms)
    out = []
    for i in range(len(words) - size + 1):
        if all(words[i + j].startswith(t) if phrase.prefix and j == size - 1 else words[i + j] == t for j, t in enumerate(phrase.terms)):
            out.append(i)
    return [i for i in out if i == 0] if phrase.first else out


def with_snippet(page: DataFrame, text: str, query: str, window: int = WINDOW) -> DataFrame:
    """``page`` with ``snippet``. Meant for the rows of a page, after ranking."""

    @F.pandas_udf("string")
    def make(column: pd.Series) -> pd.Series:
        return column.map(lambda t: None if t is None else snippet_text(t, query, window))

    return page.withColumn("snippet", make(F.col(text)))
