"""p10: sentences of documents in any script, by a linear-chain tagger over characters and Viterbi decoding.

Every character is tagged *boundary* (a sentence ends with it) or *inside*. Only some characters can be boundaries (the last of a run
of final marks with its closing quotes, brackets and footnote marks; in scripts without final marks the last
before a space); all others are clamped to inside, so a chain runs over the candidates. Its weights are stored beside this module
(``sentence_weights.json``), so that a document is split alike whatever the rest of the corpus is, and no query trains anything. They come from :func:`fit`, an
averaged structured perceptron over a sample bounded in rows and bytes, labelled by cautious rules over fixed
lists (there are no labelled sentences to learn from), so the tagger generalises those rules; for scripts without
punctuation it is trained on text stripped of any as well, labelled by the marks that were there and else by rule, so that it
rests on spacing and neighbours alone. ``python -m quire.llm.sentences TABLE...`` trains them anew on the ``text`` of tables.
A blank line always ends a sentence, and a line break alone never does: these are no matter of weights.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.lookalike import same_form
from quire.session import spread

#: Most documents and bytes in the training sample (the documents with the smallest hashes), and passes over them.
SAMPLE, SAMPLE_BYTES, PASSES = 20_000, 64_000_000, 8
#: Candidates whose scores are remembered: most look like one before.
REMEMBERED = 1 << 17
STORED = Path(__file__).with_name("sentence_weights.json")

# Final marks, closing and opening marks, footnote marks, blanks (Unicode White_Space).
FINAL = ".!?…‥。．！？｡؟۔।॥።፧፨׃;;។៕။།༎"
CLOSING = "\"'”’»›“‘)]}）］｝」』】〉》〕"
OPENING = "\"'“‘„‚«‹([{（［｛「『【〈《〔¿¡"
NOTE = "¹²³⁴⁵⁶⁷⁸⁹⁰*†‡§"
WHITE = "\t\n\v\f\r \x85\xa0                　"
# The opening marks each closing quote can belong to.
PAIRS = {"”": "“„”", "“": "„", "»": "«", "›": "‹", "」": "「", "』": "『", "’": "‘‚", "‘": "‚", "'": "'", '"': '"', "》": "《", "〉": "〈"}
# Abbreviations that something must follow (lower case except where case tells them apart).
LEADING = set(
    "dr mr mrs ms prof st mt lt col gen capt sgt rev hon no nr vol vols v vv vs pp fig figs cf ca ch chap i.e e.g a.k.a viz ed eds approx "
    "abb kap vgl bzw d.h z.b d z b h s sog geb sr sra srta d cap a p ej núm pág art c.-à-d ex av mme mlle "
    "гл ст см т к г н им ул стр рис акад проф βλ κεφ στ π.χ δηλ σελ αρ κ ص د ج डॉ श्री ดร รศ ผศ".split()
)
LEADING_EXACT = {"M", "V", "B", "MS", "MSS"}
# Abbreviations that may also end a sentence.
EITHER = set("b.c a.d a.m p.m etc chr j.-c c m km cm kg μ χλμ д др э π.χ et.al jr sr inc ltd co usw u.a א".split()) - {"sr", "π.χ"}
# Words before a number with a period that make it an ordinal.
BEFORE_ORDINAL = set("am im vom zum beim dem den der des das ein einem einen eines ihr sein kein jeder jedem jeden".split())

LEADING, EITHER, BEFORE_ORDINAL = ({same_form(x) for x in words} for words in (LEADING, EITHER, BEFORE_ORDINAL))

_BLANK_LINE = re.compile(r"(?:\r\n|[\n\r\x85 ])[^\S\n\r\x85  ]*(?:\r\n|[\n\r\x85 ])| ")
_FINALS = re.escape(FINAL)
_CANDIDATE = re.compile(rf"[{_FINALS}]+(?:[{re.escape(CLOSING + NOTE)}]|[\xa0  ]?»)*")
#: Scripts that end sentences with a space: Thai and Lao.
_UNMARKED = re.compile(r"[฀-໿]")
_SPACE = re.compile(r"(?<=\S)[^\S\n\r\x85  ]+(?=\S)")
_BEFORE = re.compile(rf"[^{re.escape(WHITE)}]*$")
#: A sentence that runs into the word for want of a blank.
_JOINED = re.compile(r"^.*[^\W\d_]{3,}[.!?]+(?=[^\W\d_])")
_BARE = frozenset(FINAL + CLOSING + OPENING + NOTE + WHITE)
_STRIPPED = str.maketrans({c: None for c in FINAL + CLOSING + OPENING + NOTE + ",:-–—、，"})


def _kind(ch: str) -> str:
    if ch.isdigit() or ch.isnumeric():
        return "0"
    if ch.islower():
        return "a"
    if ch.isupper() or ch.istitle():
        return "A"
    if ch in OPENING:
        return "("
    if ch.isalpha() or unicodedata.category(ch)[0] in "LM":
        return "x"
    return ","


class Candidate:
    """A place where a sentence may end: ``end`` (exclusive) and what its neighbourhood looks like."""

    __slots__ = ("end", "mark", "token", "shape", "before", "closer", "opened", "space", "next", "unmarked", "bare")

    def __init__(self, end, mark, token="", shape="", before="", closer="", opened="", space="", next="", unmarked=False):
        self.end, self.mark, self.token, self.shape, self.before = end, mark, token, shape, before
        self.closer, self.opened, self.space, self.next, self.unmarked = closer, opened, space, next, unmarked
        self.bare = False  # right after another, with nothing but marks and blanks between

    def look(self) -> tuple:
        """All that :meth:`features` depend on."""
        return self.mark, self.token, self.shape, self.before, self.closer, self.opened, self.space, self.next, self.unmarked

    def features(self) -> tuple[str, ...]:
        if self.unmarked:
            return (f"u{self.shape}{self.next}", f"ul{self.shape}", f"ur{self.next}", "u")
        a, n = self.mark, self.next
        return (
            f"m{a}{n}{self.space}", f"s{a}{self.shape}{n}{self.space}", f"t{self.token}{n}", f"t{self.token}", f"n{n}{self.space}",
            f"c{self.closer}{self.opened}{n}", f"c{a}{self.closer}{n}", f"q{self.closer}{self.opened}{n}{self.space}", f"o{self.shape}{self.before}{n}", f"b{self.before}{self.token}{n}", "1",
        )


def candidates(text: str, lo: int, hi: int) -> list[Candidate]:
    """The candidates of one paragraph ``text[lo:hi]``, in order; the end of the paragraph itself is none."""
    found = []
    for m in _CANDIDATE.finditer(text, lo, hi):
        run, at = m[0], m.start()
        run = run[: _closed(text, lo, at, run)]
        end = at + len(run)
        mark = run[0]
        if run[:3] == "..." or mark in "…‥":
            mark = "…"
        elif len(run) > 1 and run[1] in "?!？！":
            mark = run[1]
        if mark in ";;":
            if not (at > lo and "Ͱ" <= text[at - 1] <= "Ͽ" or at > lo and "ἀ" <= text[at - 1] <= "῿" or at > lo and text[at - 1] == "́"):
                continue
            mark = "?"
        closer = "".join(c for c in run if c in CLOSING)
        q = end
        while q < hi and (text[q] in WHITE or unicodedata.category(text[q]) == "Cf"):
            q += 1
        if q >= hi:
            continue  # the paragraph ends a sentence anyway
        between = text[end:q]
        space = "" if not between else "n" if any(c in "\n\r\x85 " for c in between) else "s"
        tail = text[max(lo, at - 40) : at]
        word = _BEFORE.search(tail)[0]
        token = same_form(_JOINED.sub("", word).lstrip(OPENING).rstrip(CLOSING))
        rest = tail[: len(tail) - len(word)].rstrip(WHITE)
        before = same_form(_JOINED.sub("", _BEFORE.search(rest)[0]).strip(OPENING)).lower()[:8] if rest else ""
        digits = bool(token) and all(c.isdigit() or c in ".,:;–-" for c in token)
        shape = "0" if digits else "" if not token else ("1" if len(token) == 1 else "." if "." in token else "w") + _kind(token[0])
        name = "#" if digits else token if len(token) == 1 or token in LEADING_EXACT else token.lower() if len(token) <= 8 else "*"
        opened = ""
        if closer:
            for c in closer:
                if c in PAIRS:
                    o = max((text.rfind(x, lo, at) for x in PAIRS[c]), default=-1)
                    if o >= 0:
                        p = o - 1
                        while p >= lo and text[p] in WHITE:
                            p -= 1
                        opened = "S" if p < lo or text[p] in FINAL + CLOSING + NOTE or (p < o - 1 and _UNMARKED.match(text[p])) else "M"
                    break
            else:
                opened = "b"
            closer = "q" if opened in "SM" else "b"
        found.append(Candidate(end, mark, name, shape, before if digits or len(token) <= 2 else "", closer, opened, space, _kind(text[q])))
    if _UNMARKED.search(text, lo, hi):
        taken = {c.end for c in found}
        for m in _SPACE.finditer(text, lo, hi):
            left, right = _near(text, m.start() - 1, -1, lo, hi), _near(text, m.end(), 1, lo, hi)
            if m.start() not in taken and (_UNMARKED.match(left) or left.isdigit() and _UNMARKED.match(right)):
                found.append(Candidate(m.start(), " ", shape="T" if _UNMARKED.match(left) else _kind(left or ","), next="T" if _UNMARKED.match(right) else _kind(right or ","), unmarked=True))
        found.sort(key=lambda c: c.end)
    at = lo
    for c in found:
        c.bare = c.end - at <= 2 and all(x in _BARE or unicodedata.category(x) == "Cf" for x in text[at : c.end])
        at = c.end
    return found


def _closed(text: str, lo: int, at: int, run: str) -> int:
    """The length of a run without quotes that open what follows: a mark that opens in one language and closes in another (or looks
    the same at both ends) closes only what is open."""
    for i, c in enumerate(run):
        if c in "“‘":
            own = "„" if c == "“" else "‚"
            if text.rfind(own, lo, at) <= text.rfind(c, lo, at):
                return i
        elif c in "\"'" and text[at + i + 1 : at + i + 2].isalnum():
            return i
    return len(run)


def _near(text: str, at: int, step: int, lo: int, hi: int) -> str:
    """The nearest character of the word there, punctuation stripped."""
    while lo <= at < hi and text[at] not in WHITE:
        if text[at].translate(_STRIPPED):
            return text[at]
        at += step
    return ""


def rule(c: Candidate) -> bool:
    """The cautious rules that label the training sample."""
    if c.unmarked:
        return "0" not in (c.shape, c.next)
    if c.next in ("a", ","):
        return False
    if c.closer == "q" and c.next == "x":
        return c.opened != "S"  # a quotation that opens the sentence has its clause still to come
    if c.mark == "…" and not c.closer:
        return c.next in ("A", "(")
    if c.mark != "." or c.closer:
        return c.mark not in "…" or c.next in ("A", "(", "0") or c.closer == "b"
    low = c.token.lower()
    if not c.space:
        return c.next == "A" and c.shape[:1] == "w" and low not in LEADING and low not in EITHER and c.token not in LEADING_EXACT
    if c.shape == "0":
        return not (c.next == "A" and c.before in BEFORE_ORDINAL)
    if c.token in LEADING_EXACT:
        return False
    if low in EITHER and c.token == low or low in ("b.c", "a.d", "chr", "j.-c") or c.token == "C" and c.before == "a.":
        return not (low == "э" and c.next == "A")
    if low in LEADING:
        return False
    if c.shape == "1A":
        return False  # an initial
    return True


def viterbi(rows: list[Candidate], weights: dict[str, float], known: dict[tuple, float] | None = None) -> list[bool]:
    """The best tags of a chain; two boundaries next to each other are possible only with something between. ``known``: scores by what a candidate
    looks like, for weights that stay as they are."""
    inside, ends = 0.0, float("-inf")
    back: list[tuple[bool, bool]] = []
    get = weights.get
    for c in rows:
        look = c.look()
        score = None if known is None else known.get(look)
        if score is None:
            score = sum(get(f, 0.0) for f in c.features())
            if known is not None and len(known) < REMEMBERED:
                known[look] = score
        from_inside, from_end = inside + get(">ib", 0.0), ends + (float("-inf") if c.bare else get(">bb", 0.0))
        stay_inside, stay_end = inside + get(">ii", 0.0), ends + get(">bi", 0.0)
        back.append((stay_end > stay_inside, from_end > from_inside))
        inside, ends = max(stay_inside, stay_end), max(from_inside, from_end) + score
    tag, out = ends > inside, []
    for to_inside, to_end in reversed(back):
        out.append(tag)
        tag = to_end if tag else to_inside
    return out[::-1]


def _bared(text: str, lo: int, hi: int, rows: list[Candidate]) -> tuple[list[Candidate], list[bool]]:
    """The candidates of a paragraph stripped of punctuation, and their labels: what the marks that were there told (``rows``), else the rule."""
    told, marked, kept = {}, {c.end: rule(c) for c in rows if not c.unmarked}, []
    for i in range(lo, hi):
        if i in marked:
            told[len(kept)] = told.get(len(kept), False) or marked[i]
        if text[i].translate(_STRIPPED):
            kept.append(text[i])
    bare = "".join(kept)
    own = candidates(bare, 0, len(bare))
    return own, [told.get(c.end, rule(c)) for c in own]


def train(texts: Iterable[str], passes: int = PASSES) -> dict[str, float]:
    """Averaged structured perceptron over the paragraphs of ``texts``; weights by feature. Paragraphs in unmarked scripts
    are learnt twice, as they are and stripped of punctuation."""
    chains, seen = [], set()
    for text in texts:
        for lo, hi in paragraphs(text or ""):
            rows = candidates(text, lo, hi)
            own = [(rows, [rule(c) for c in rows])]
            if _UNMARKED.search(text, lo, hi):
                own.append(_bared(text, lo, hi, rows))
            for rows, gold in own:
                key = (tuple(c.features() for c in rows), tuple(gold))
                if rows and key not in seen:
                    seen.add(key)
                    chains.append((rows, gold))
    weights: dict[str, float] = defaultdict(float)
    total: dict[str, float] = defaultdict(float)
    step = 1
    for _ in range(passes):
        wrong = 0
        for rows, gold in chains:
            step += 1
            guess = viterbi(rows, weights)
            if guess == gold:
                continue
            wrong += 1
            for tags, by in ((gold, 1.0), (guess, -1.0)):
                last = False
                for c, tag in zip(rows, tags):
                    if tag:
                        for f in c.features():
                            weights[f] += by
                            total[f] += by * step
                    f = ">" + "ib"[last] + "ib"[tag]
                    weights[f] += by
                    total[f] += by * step
                    last = tag
        if not wrong:  # all learnt: the weights as they are
            return {f: w for f, w in weights.items() if w}
    return {f: round(w - total[f] / step, 6) for f, w in weights.items() if w - total[f] / step}


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    """Stretches between blank lines."""
    at = 0
    while at < len(text):
        m = _BLANK_LINE.search(text, at)
        if not m:
            break
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def sentences(text: str | None, weights: dict[str, float], known: dict[tuple, float] | None = None) -> list[tuple[int, int]]:
    """``(start, end)`` of each sentence in code points, end exclusive, blanks at both ends left out."""
    out, text = [], text or ""
    for lo, hi in paragraphs(text):
        rows = candidates(text, lo, hi)
        stops = [c.end for c, tag in zip(rows, viterbi(rows, weights, known)) if tag] + [hi]
        at = lo
        for stop in stops:
            part = text[at:stop]
            start = at + len(part) - len(part.lstrip(WHITE))
            end = at + len(part.rstrip(WHITE))
            if start < end:
                out.append((start, end))
            at = stop
    return out


def fit(df: DataFrame, text: str, *, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, passes: int = PASSES) -> dict[str, float]:
    """Weights learnt from at most ``sample`` texts and ``sample_bytes`` bytes of ``df``: those with the smallest hashes, whatever the size of the table. They come to the driver
    a partition at a time."""
    chosen = df.select(F.col(text).alias("t")).where(F.octet_length("t").between(1, sample_bytes)).orderBy(F.xxhash64("t")).limit(sample)
    texts, size = [], 0
    for row in chosen.toLocalIterator():
        size += len(row["t"].encode())
        if size > sample_bytes:
            break
        texts.append(row["t"])
    return train(sorted(texts), passes)


@lru_cache(maxsize=1)
def stored_weights() -> dict[str, float]:
    return json.loads(STORED.read_text("utf-8"))


def split(df: DataFrame, key: str, text: str, *, weights: dict[str, float] | None = None) -> DataFrame:
    """``(doc_id, start_pos int, end_pos int)`` of every sentence of every whole text, ``doc_id`` being ``key``.

    ``weights`` (of :func:`fit`; else the stored ones, a few thousand numbers) go to the tasks with the function. Null, empty and blank texts have no sentences.
    """
    weights = stored_weights() if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}
        for batch in batches:
            keys, starts, ends = [], [], []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for a, b in sentences(t, weights, known):
                    keys.append(k)
                    starts.append(a)
                    ends.append(b)
            yield pa.record_batch([pa.array(keys, batch.schema.types[0]), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    rows = spread(df.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("t")), "doc_id")
    return rows.mapInArrow(run, f"doc_id {dict(df.dtypes)[key]}, start_pos int, end_pos int")


def main(tables: list[str]) -> None:
    from quire.session import local_session, ship

    spark = ship(local_session())
    learnt = fit(spark.read.parquet(*tables).select("text"), "text")
    STORED.write_text(json.dumps(dict(sorted(learnt.items())), ensure_ascii=False, indent=0) + "\n", "utf-8")


if __name__ == "__main__":
    import sys

    main(sys.argv[1:])
