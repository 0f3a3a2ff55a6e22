"""Training-data operators against brute force, round trips and the reference tokenizer library."""

import random
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import bpe, lookalike, neighbours, packing, sentences, termfreq, topn
from quire.llm.graph import PrunedGraph

VOCABULARY = Path(bpe.VOCABULARIES) / bpe.VOCABULARY


# -- p1 ---------------------------------------------------------------------------
def clustered(rng, n, dim=16):
    centres = rng.normal(size=(n // 6 + 1, dim))
    return (centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * 0.12) * rng.uniform(0.2, 6, size=(n, 1))


def brute(ids, x, k, floor):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 12)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        c = np.flatnonzero(s[i] >= floor)
        for j in c[np.lexsort((ids[c], -s[i][c]))][:k]:
            out.add((int(min(ids[i], ids[j])), int(max(ids[i], ids[j]))))
    return out


def test_graph_finds_what_a_scan_finds():
    x = clustered(np.random.default_rng(0), 3000, 32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = PrunedGraph(x)
    found, sims = graph.search(x)
    exact = x @ x.T
    top = np.argsort(-exact, 1)[:, :5]
    assert np.mean([len(set(a) & set(b[b >= 0])) / 5 for a, b in zip(top, found)]) > 0.97
    assert (np.diff(sims, axis=1) <= 1e-6).all()
    assert graph.search(x[:0])[0].shape[0] == 0
    assert PrunedGraph(x[:1]).search(x[:2])[0][:, 0].tolist() == [0, 0]


@pytest.mark.parametrize(("shard", "askers"), [(8192, 10**6), (150, 400), (20, 10**6)])
def test_neighbours_reach_recall(spark, shard, askers):
    # shards of 20: 60 shards, hundreds of lists, 8 of them asked; 400 askers a shard: most shards are kept several times
    rng = np.random.default_rng(2)
    x = clustered(rng, 1200)
    ids = rng.permutation(5000)[: len(x)]
    x = x.astype(np.float32).astype(np.float64)
    rows = [(int(i), v.tolist(), "noise") for i, v in zip(ids, x)]
    bad = [(9001, None, ""), (9002, [1.0] * 15, ""), (9003, [0.0] * 16, ""), (9004, [float("nan")] * 16, ""), (9005, [None] * 16, ""), (None, [1.0] * 16, ""), (9006, [], "")]
    df = spark.createDataFrame(rows + rows[:40] + bad, "vec_id long, vector array<float>, cells string")
    got = [tuple(r) for r in neighbours.pairs(neighbours.nearest(df, dim=16, shard=shard, askers=askers)).collect()]
    want = brute(ids, x, 5, 0.85)
    assert len(got) == len(set(got)) and set(got) <= {p for p in want} | set(got)
    assert len(set(got) & want) >= 0.97 * len(want)
    assert len(set(got) - want) <= 0.03 * len(want)


def test_lists_in_two_levels(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "DIRECT", 100)
    rng = np.random.default_rng(3)
    x = clustered(rng, 3000).astype(np.float32).astype(np.float64)
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<float>")
    got = {tuple(r) for r in neighbours.pairs(neighbours.nearest(df, dim=16, shard=60, sample=800)).collect()}
    want = brute(ids, x, 5, 0.85)
    assert len(got & want) >= 0.95 * len(want)


def test_equal_vectors_and_ties(spark):
    same = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(40, 0, -1)]
    near = [(100, [1.0, 2.0, 3.0, 4.1]), (101, [-1.0, 0.0, 0.0, 0.0]), (102, [1.0, 2.0, 3.0, 4.0]), (103, [0.0, 0.0, -1.0, 0.0]), (104, [-0.0, 0.0, -1.0, 0.0])]
    df = spark.createDataFrame(same + near, "vec_id long, vector array<float>")
    got = {tuple(r) for r in neighbours.nearest(df, dim=4).select("id", "neighbour").collect()}
    want = {(i, j) for i in [*range(1, 41), 102] for j in [x for x in range(1, 7) if x != i][:5]} | {(100, j) for j in range(1, 6)} | {(103, 104), (104, 103)}
    assert got == want
    assert neighbours.nearest(df.limit(0), dim=4).count() == 0


def test_neighbours_around_a_hot_vector(spark):
    rng = np.random.default_rng(4)
    hot = rng.normal(size=8)
    hot /= np.linalg.norm(hot)
    around = hot + rng.normal(size=(400, 8)) * 0.12
    far = rng.normal(size=(600, 8))
    x = np.concatenate([np.tile(hot, (500, 1)), around, far]).astype(np.float32).astype(np.float64)
    ids = rng.permutation(5000)[: len(x)]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, vector array<float>")
    got = {tuple(r) for r in neighbours.pairs(neighbours.nearest(df, dim=8, shard=30)).collect()}
    copies, near = set(ids[:500].tolist()), set(ids[500:900].tolist())
    want = {p for p in brute(ids, x, 5, 0.85) if near & {*p}}
    assert any(copies & {*p} for p in want)
    assert len(got & want) >= 0.97 * len(want)
    centres = neighbours.fit_cells(neighbours.unit(x), 50)
    assert len(np.unique(centres.round(6), axis=0)) == len(centres) > 8
    assert len(np.unique((neighbours.unit(x) @ centres.T).argmax(1))) == len(centres)


# -- p4 ---------------------------------------------------------------------------
def test_term_counts(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.randint(1, 30), p, rng.choice(["hot"] * 6 + ["x", "y ", " z", "", "  ", None])) for p in range(900)]
    rows += rows[:200]
    df = spark.createDataFrame(rows, "text string, verse int, position int, term string")
    term = F.upper(F.trim("term"))
    for cap in (1_000_000, 40):
        got = {r.term: (r.occurrences, r.records) for r in termfreq.term_counts(df, F.when(term != "", term), ["text", "verse"], cap=cap).collect()}
        want = {}
        for text, verse, _, t in set(rows):
            t = (t or "").strip().upper() or None
            own = want.setdefault(t, [0, set()])
            own[0] += 1
            own[1].add((text, verse))
        records = len({(a, b) for a, b, _, _ in rows})
        assert {t: v for t, v in got.items() if t} == {t: (n, len(s)) for t, (n, s) in want.items() if t}
        assert got[None][1] == records
        marks = {(r.term, r.mark) for r in termfreq.marked(termfreq.term_counts(df, F.when(term != "", term), ["text", "verse"], cap=cap), 3, 0.5).collect() if r.mark}
        assert marks == {(t, m) for t, (_, n) in got.items() if t for m, is_so in (("rare", n < 3), ("common", n >= records * 0.5)) if is_so}
    assert termfreq.marked(termfreq.term_counts(df.limit(0), term, ["text", "verse"])).count() == 0


def test_radix_covers_all(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("h")).union(spark.range(500).select(F.lit(7).cast("long").alias("h"))).union(spark.range(400).select((F.lit(2**40) + F.col("id")).alias("h")))
    for cap, cap_bytes in ((100, 10**9), (10**9, 1000)):
        parts = termfreq.radix(df, "h", F.lit(10), cap=cap, cap_bytes=cap_bytes)
        sizes = {r["leaf"]: (r["n"], r["one"]) for r in df.groupBy(parts.leaf(F.col("h")).alias("leaf")).agg(F.count("*").alias("n"), (F.min("h") == F.max("h")).alias("one")).collect()}
        assert sum(n for n, _ in sizes.values()) == 3900 and all(0 <= leaf < parts.count for leaf in sizes)
        assert all(n <= 100 or one for n, one in sizes.values())  # equal hashes cannot be split
        assert parts.split
    assert termfreq.radix(df.limit(0), "h", F.lit(10)).split == ()


# -- p5 ---------------------------------------------------------------------------
SAME = [("the", "ｔｈｅ"), ("café", "café"), ("a b", "a b"), ("a b", "a b"), ("paper", "рареr"), ("ab", "a​b"), ("ab", "a­b"), ("K", "K"), ("שָׁ", "שָׁ"), ("ή", "ή"), (";", ";"), ("ό", "о́"), ("ё", "ё"), ("שׂ", "שׂ"), ("", "​"), ("한", "한"), ("a-b", "a‑b")]
OTHER = [("the", "The"), ("e", "é"), ("1", "¹"), ("a b", "a  b"), ("ш", "щ"), ("ab", "a b"), ("ß", "ss"), ("ﬁ", "fi"), ("ד", "דּ"), ("…", "..."), ("v", "ν" + "́"), ("é", "è")]


def test_forms():
    for a, b in SAME:
        assert lookalike.same_form(a) == lookalike.same_form(b), (a, b)
    for a, b in OTHER:
        assert lookalike.same_form(a) != lookalike.same_form(b), (a, b)


def test_forms_are_fixpoints():
    rng = random.Random(0)
    pool = [chr(c) for c in [*range(32, 0x600), *range(0x1E00, 0x2070), *range(0xFB00, 0xFB50), *range(0xFF00, 0xFFF0), 0x1F600, 0x1D17A]]
    for _ in range(3000):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 9)))
        form = lookalike.same_form(text)
        assert lookalike.same_form(form) == form
        assert lookalike.same_form(unicodedata.normalize("NFC", text)) == form == lookalike.same_form(unicodedata.normalize("NFD", text))


def test_conflicts_are_refused():
    with pytest.raises(lookalike.MappingConflict):
        lookalike.Transducer([("a", "b"), ("a", "c")])
    with pytest.raises(lookalike.MappingConflict):
        lookalike.Transducer([("a", "b"), ("b", "c")])
    assert lookalike.Transducer([("a", "1"), ("abc", "2")]).read("ababcab") == "1b21b"


def test_alike_pairs(spark):
    rows = [("1", "the"), ("2", "ｔｈｅ"), ("3", "the"), ("1", "the"), ("4", "The"), ("5", None), (None, "the"), ("6", ""), ("7", "​"), ("10", "t​he"), ("8", "x" * 50_000 + "é"), ("9", "x" * 50_000 + "é")]
    df = spark.createDataFrame([(*r, "f") for r in rows], "k string, t string, f string")
    got = sorted(tuple(r) for r in lookalike.alike_pairs(df, "k", "t").collect())
    assert got == [("1", "10"), ("1", "2"), ("10", "2"), ("10", "3"), ("2", "3"), ("6", "7"), ("8", "9")]
    classes = {}
    for r in lookalike.alike_classes(df, "k", "t").collect():
        classes.setdefault(bytes(r.class_id), set()).add(r.key)
    assert sorted(map(sorted, classes.values())) == [["1", "10", "2", "3"], ["6", "7"], ["8", "9"]]
    assert lookalike.alike_pairs(df.limit(0), "k", "t").count() == 0


# -- p6 ---------------------------------------------------------------------------
@pytest.mark.parametrize("parts", [1, 7])
def test_top_n(spark, parts):
    rng = random.Random(6)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([1, 1, 2, None]), i, rng.choice([None, *range(-3, 9)])) for i in range(4000)]
    rows += rows[:500] + [("one", 1, None, 5)]
    df = spark.createDataFrame(rows, "g string, c int, id long, score int").repartition(parts)
    got = sorted((tuple(r) for r in topn.top_n(df, ["g", "c"], "score", "id", 3).select("g", "c", "id").collect()), key=repr)
    groups = {}
    for g, c, i, s in set(rows):
        if s is not None and i is not None:
            groups.setdefault((g, c), []).append((-s, i))
    assert got == sorted(((g, c, i) for (g, c), v in groups.items() for _, i in sorted(v)[:3]), key=repr)
    assert topn.top_n(df.limit(0), ["g", "c"], "score", "id", 3).count() == 0


# -- p8 ---------------------------------------------------------------------------
PIECES = ["'", "'s", "'ll", "'re", "'v", "'T", "l", " ", "  ", "\n", "\t", " ", "　", "a", "é", "1", "²", ".", "!?", "😀", "\x1c", "\x85", "中", "<|endoftext|>", "​", "́", "\0", "\r\n", "word"]


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_ids_match_the_tokenizer_library():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(str(VOCABULARY))
    library.encode_special_tokens = True
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["a" * 3000, "ab" * 2000 + " " * 300, " " * 9 + "x", "." * 500, "x " * 30_000]
    vocab = bpe.vocabulary(str(VOCABULARY))
    found = list(bpe.encode_batch(texts, vocab))
    for text, (ids, ends), want in zip(texts, found, library.encode_batch(texts, add_special_tokens=False)):
        assert ids == want.ids, text[:80]
        assert bpe.decode(ids, vocab) == text
        for i in range(0, len(ends), 2):  # offsets: each piece decodes by itself
            lo, a = (ends[i - 2], ends[i - 1]) if i else (0, 0)
            assert bpe.decode(ids[a : ends[i + 1]], vocab) == text[lo : ends[i]]


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_both_files_give_the_same_ids():
    a, b = bpe.vocabulary(str(VOCABULARY)), bpe.vocabulary(str(VOCABULARY.with_suffix(".tiktoken")))
    texts = ["The shepherd's flock", "naïve  café\n\n", "12345"]
    assert [x for x, _ in bpe.encode_batch(texts, a)] == [x for x, _ in bpe.encode_batch(texts, b)]


def test_machine_against_the_pattern():
    import regex

    pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
    rng = random.Random(1)
    for _ in range(3000):
        text = "".join(rng.choice([p for p in PIECES if p not in ("\x1c",)]) for _ in range(rng.randint(1, 12)))
        code = np.array([*map(ord, text), 0])
        flag = np.zeros(len(code), bool)
        flag[-1] = True
        assert bpe.piece_starts(code, flag)[:-1].tolist() == [m.start() for m in pattern.finditer(text)], repr(text)


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary files")
def test_null_and_empty_texts(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "hi", "x"), (4, " ", "x"), (3, "hi", "x"), (None, "hi", "x")], "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, r.ids) for r in bpe.token_ids(df, "doc_id", "text").collect()), key=repr)
    assert got == sorted([(1, []), (2, []), (3, [5303]), (3, [5303]), (4, [220]), (None, [5303])], key=repr)
    assert bpe.token_ids(df.limit(0), "doc_id", "text", offsets=True).count() == 0


# -- p9 ---------------------------------------------------------------------------
def test_packing(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([0, None, 1, 5, 30, 64, 100, 101, 257, rng.randint(1, 90)])) for i in range(6000)] + [(10, 7), (10, 7)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc long, tokens int, container int")
    out = packing.pack(df, "doc", "tokens", 100, part=2500).collect()
    by = {}
    for r in out:
        if r.container is not None:
            by.setdefault(r.container, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.position)
        assert own[0].position == 0 and all(a.position + a["size"] == b.position for a, b in zip(own, own[1:]))
        assert own[-1].position + own[-1]["size"] <= 100
    assert sorted((r.doc, r["size"]) for r in out) == sorted((d, s) for d, n in rows for s in ([100] * ((n or 0) // 100) + ([(n or 0) % 100] if (n or 0) % 100 or not n else [])))
    total = sum(r["size"] for r in out)
    assert total <= 100 * len(by)
    bins, room = 0, [0] * 101  # best fit decreasing over all pieces at once
    for size in sorted((r["size"] for r in out if r["size"]), reverse=True):
        at = next((x for x in range(size, 101) if room[x]), None)
        if at is None:
            bins, at = bins + 1, 100
        else:
            room[at] -= 1
        room[at - size] += 1
    assert len(by) <= 1.03 * bins
    assert packing.pack(df.limit(0), "doc", "tokens", 100).count() == 0


def test_sum_of_squares_is_the_best_choice():
    rng = random.Random(3)
    s = packing.SumOfSquares(12)
    for _ in range(400):
        size = rng.randint(1, 11)
        before = s.level.copy()
        costs = {}
        for h in [0, *[h for h in range(1, 13 - size) if before[h]]]:
            after = before.copy()
            if h:
                after[h] -= 1
            if h + size < 12:
                after[h + size] += 1
            costs[h] = int((after**2).sum())
        s.place(size)
        assert int((s.level**2).sum()) == min(costs.values())


# -- p10 --------------------------------------------------------------------------
# Sentences of our own, divided by "|".
DIVIDED = [
    "The road is long.| The mill of Ken, ca. 40 B.C. at the earliest, fell.| It fell in 50 B.C.| Then Dr. Oss and Mrs. Lim left at 6 a.m. by boat.",
    "“Who goes?” asked the scribe.| The ferry said, “All is well.”| Was it so?!| Yes… the wall stood.| (The end is lost.)| See fig. 3.5 in MS. 9.| 40 men came.²| Done.",
    "A heading\n\nIt was told.|\nThen it ended\nat last.|",
    "Am 8. Tag kam Oss.| Das geschah 40 v. Chr.| „Wer kommt?“, fragte Lim.| Vgl. Kap. 3, V. 2, z. B. zu Fluss.|Auch hier.",
    "La tour tomba en 5 av. J.-C.| M. Oss compte 3,4 coudées, c.-à-d. 2.3 m.| « Qui vient ? » demanda Lim.| Pourquoi ?",
    "Τότε ήρθε.| Γιατί η Κεν πέρασε;| «Ποια ήρθε;» ρώτησε η Λιμ.| Βλ. κεφ. 2, στ. 3, π.χ. η πύλη.",
    "А. Б. Осс читает «Лим» и т. д.| В 5 г. до н. э. Осс ушёл.| «Кто там?» — спросил Лим.| См. гл. 3, ст. 4, т. е. тут.",
    "他们等候……后来走了。|“谁来了？”他问道。|他说：“在这里。”|（失传。）|为什么？|高3.5米。",
    "「行け。」と彼は言った。|なぜ来たか？|来た。",
    "د. سيل قاس 3.5 ذراعا.| «من جاء؟» سأل ليم.| انظر ص. 4 عن الباب.| لماذا؟",
    "जाओ।| “कौन आया?” लिम ने पूछा।| डॉ. ओस ने कहा, “यहीं हैं।”| अंत।",
    "ד״ר אשל מדד 8.7 אמות.| ראו פרק 6.6 על הבאר וכו׳.| „מי שם?” שאל לי.| סוף׃| אז הלך.",
    "ለካ።| “ማን መጣ፧” ሲል ጠየቀ።| ዶ/ር ሊም 4.5 ክንድ ለካ።",
    "ทางไปเมือง| หอคอยสูง 3.8 ศอก| ชาวเมือง 396 คนได้วัด| ดร.ลิมมา",
]


@pytest.fixture(scope="module")
def tagger():
    """The stored weights: none of the texts here was in their sample."""
    return sentences.stored_weights()


@pytest.mark.parametrize("divided", DIVIDED)
def test_sentences(tagger, divided):
    parts = [p for piece in divided.split("|") for p in piece.split("\n\n")]
    text = divided.replace("|", "")
    got = [text[a:b] for a, b in sentences.sentences(text, tagger)]
    assert got == [p.strip() for p in parts if p.strip()]


def test_blank_lines_and_breaks(tagger):
    text = "One\ntwo three\n \nFour\r\n\r\nFive Six"
    assert [text[a:b] for a, b in sentences.sentences(text, tagger)] == ["One\ntwo three", "Four", "Five", "Six"]


def test_sentences_of_one_character(tagger):
    text = "他们走了。好。后来呢？"
    assert [text[a:b] for a, b in sentences.sentences(text, tagger)] == ["他们走了。", "好。", "后来呢？"]
    text = "他们走了。 。后来呢？"  # marks alone are no sentence
    assert len(sentences.sentences(text, tagger)) == 2


def test_unmarked_scripts_learn_from_stripped_text():
    weights = sentences.train(["ทางไปเมือง! ชาวเมือง 396 คน! หอคอย! ลิมมา"] * 3)
    text = "ลิมมา หอคอย 38 ศอก ทางไปเมือง"
    assert [text[a:b] for a, b in sentences.sentences(text, weights)] == ["ลิมมา", "หอคอย 38 ศอก", "ทางไปเมือง"]


def test_viterbi_is_the_best_path(tagger):
    rng = random.Random(0)
    text = "A b. C d? E. f! G… H."
    rows = sentences.candidates(text, 0, len(text))
    for _ in range(50):
        weights = {f: rng.uniform(-1, 1) for c in rows for f in c.features()} | {k: rng.uniform(-1, 1) for k in (">ii", ">ib", ">bi", ">bb")}

        def total(tags):
            out, last = 0.0, False
            for c, tag in zip(rows, tags):
                out += weights[">" + "ib"[last] + "ib"[tag]] + (sum(weights[f] for f in c.features()) if tag else 0)
                last = tag
            return out

        import itertools

        best = max(total(t) for t in itertools.product([False, True], repeat=len(rows)))
        assert total(sentences.viterbi(rows, weights)) == pytest.approx(best)


def test_split(spark):
    rows = [(1, "It fell. Then it rose."), (2, None), (3, ""), (4, " \n\t "), (5, "x" * 200_000 + ". End."), (1, "No end")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "id long, text string, doc_id int")
    got = sorted(tuple(r) for r in sentences.split(df, "id", "text").collect())
    assert got == [(1, 0, 6), (1, 0, 8), (1, 9, 22), (5, 0, 200_001), (5, 200_002, 200_006)]
    assert sentences.split(df.limit(0), "id", "text").count() == 0
    learnt = sentences.fit(df, "text", sample=10, sample_bytes=100)
    assert sorted(tuple(r) for r in sentences.split(df.where("id = 1"), "id", "text", weights=learnt).collect())[0] == (1, 0, 6)
