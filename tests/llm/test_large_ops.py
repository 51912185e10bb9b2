"""Operators with an index, a model or sketches, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from adlattice.llm import near_dedup, nearest, quality_classifier, sentencepiece

from .conftest import LONG, ODD


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, score double")


def test_nearest_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((6, 16))
    data = [(i, (base[i % 6] + 0.6 * rng.standard_normal(16)).tolist(), 0.0) for i in range(400)]
    data += [(400 + i, data[3][1], 0.0) for i in range(60)]  # one vector many times
    data += [(900, None, 0.0), (901, [], 0.0), (902, [0.0] * 16, 0.0), (920, [float("nan")] + [1.0] * 15, 0.0), (940, [None] + [1.0] * 15, 0.0)]
    table = vectors(spark, data)
    got = nearest.search(table, table.where("vec_id % 20 = 0"), k=20).toPandas()
    fine = {i: np.asarray(v, dtype=np.float32).astype(float) for i, v, _ in data if i < 900}
    hits = total = 0
    for q in (i for i in fine if i % 20 == 0):
        best = sorted((-float(fine[q] @ v), i) for i, v in fine.items() if i != q)[:20]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 21))
        assert (own.score.diff().dropna() <= 1e-12).all()
        for i, s in zip(own.vec_id, own.score, strict=True):
            assert abs(float(fine[q] @ fine[i]) - s) < 1e-9
        hits += len(set(own.vec_id) & {i for _, i in best})
        total += 20
    assert hits / total >= 0.97
    assert set(got.query_id) == {i for i in fine if i % 20 == 0}


def test_nearest_test_closes_leaves_and_prunes(spark, monkeypatch):
    """Groups that lie apart: the test closes most leaves, at a recall of 0.9 at least."""
    monkeypatch.setattr(nearest, "LEAF", 64)
    rng = np.random.default_rng(3)
    base = 3.0 * rng.standard_normal((24, 32))
    data = [(i, (base[i % 24] + 0.3 * rng.standard_normal(32)).tolist(), 0.0) for i in range(1920)]
    table, counts = vectors(spark, data), {}
    got = nearest.search(table, table.where("vec_id % 20 = 0"), counts=counts).toPandas()
    fine = np.array([np.asarray(v, dtype=np.float32) for _, v, _ in data], dtype=float)
    hits = 0
    for q in range(0, 1920, 20):
        scores = fine @ fine[q]
        scores[q] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & set(got.vec_id[got.query_id == q]))
    assert hits / (20 * 96) >= 0.9
    assert counts["visits"] < 0.6 * counts["queries"] * counts["leaves"]
    assert counts["verified"] < 0.2 * counts["queries"] * counts["vectors"]


def test_nearest_of_repeated_rows(spark):
    """Repeated rows count once on either side; a vec_id of two vectors is two queries."""
    rows = [(i, [1.0 + i, 1.0], 0.0) for i in range(6)]
    once = vectors(spark, rows)
    found = lambda t: sorted(tuple(r) for r in nearest.search(t, t.where("vec_id % 2 = 0"), k=3).collect())
    assert found(vectors(spark, rows * 3)) == found(once)
    two = found(vectors(spark, [*rows, (0, [-1.0, 0.5], 0.0)]))
    assert [r[:2] for r in two if r[0] == 0] == [(0, 1), (0, 1), (0, 2), (0, 2), (0, 3), (0, 3)]
    assert (0, 1, 0, -0.5) in two  # the other vector of its own id is a candidate


def test_nearest_of_few_or_no_rows(spark):
    few = vectors(spark, [(0, [1.0, 2.0], 0.0), (1, [2.0, 1.0], 0.0), (20, [1.0, 2.0], 0.0)])
    got = sorted((r.query_id, r.rank, r.vec_id) for r in nearest.search(few, few.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 20), (0, 2, 1), (20, 1, 0), (20, 2, 1)]
    assert nearest.search(few.limit(0), few.limit(0)).count() == 0


def test_chi_square():
    assert abs(nearest.chi_square(nearest.quantile(0.95)) - 0.95) < 1e-9
    assert abs(nearest.quantile(0.95, 8) - 15.507) < 1e-3


@pytest.fixture(scope="module")
def model():
    return sentencepiece.load()


@pytest.fixture(scope="module")
def own(model):
    return sentencepiece.Segmenter(model)


@pytest.fixture(scope="module")
def library():
    lib = pytest.importorskip("sentencepiece")
    return lib.SentencePieceProcessor(model_file=sentencepiece.MODEL)


ALPHABET = ["the", "▁", "  ", " ", "a", "ing", "é", "ß", "\n", "1", "23", "...", "漢字", "😀", "\t", "hello", "==", "xyz"]


def texts(n, most, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, most))) for _ in range(n)]


def test_pieces_equal_the_library(own, library):
    some = texts(1500, 30, 1) + ["", LONG[:5000], "x" * 300]
    for text, ids in zip(some, own.encode_many(some), strict=True):
        assert ids.tolist() == library.encode(text), text
        if "▁" not in text:
            assert own.decode(ids) == text


def test_lattice_equals_merges(own):
    for word in ("▁retionwh", "▁▁▁the", "hello", "▁ééß", "abc" * 20):
        states = own.forward(word, 0, None, len(word))
        assert len(states[-1]) == 1
        assert own.back(states, len(word), next(iter(states[-1])), 0) == own._merged(word)


def test_neighbours_stay_apart_as_merges_say(own):
    rng = np.random.default_rng(4)
    left, right = (rng.choice(np.flatnonzero(own.rank_at[:-1, 0] < sentencepiece.NEVER), 3000) for _ in range(2))
    whole = [own._merged(p) == [p] for p in (own.names[i] for i in left)]
    for x, y, got, w in zip(left, right, own._apart(left, right), whole, strict=True):
        a, b = own.names[x], own.names[y]
        if w and own._merged(b) == [b]:
            assert got == (own._merged(a + b) == [a, b]), (a, b)


def test_scores_decide_for_unigram_models():
    pieces = [("<unk>", 0.0, 2), ("a", -2.0, 1), ("b", -2.5, 1), ("ab", -3.0, 1), ("aba", -7.5, 1), ("ba", -3.5, 1)]
    own = sentencepiece.Segmenter({"bpe": False, "prefix": False, "pieces": pieces})
    score = {p: s for p, s, k in pieces if k == 1}

    def best(t):
        ways = [(score.get(t[:i], own.penalty if i == 1 else -1e9), t[i:]) for i in range(1, len(t) + 1)]
        return max((s + best(rest) for s, rest in ways), default=0.0)

    for text in ("ab", "aba", "abab", "bbaab", "axb", "abaabab"):
        ids = own.encode(text).tolist()
        assert "".join(pieces[i][0] if i else "x" for i in ids) == text
        assert abs(sum(pieces[i][1] if i else own.penalty for i in ids) - best(text)) < 1e-9
        assert abs(sum(own.scores.get(p, own.penalty) for p in own.segment(text)) - best(text)) < 1e-9


def chunked(own, text, chunk):
    text, parts = own.normal(text), []
    for at in range(0, len(text), chunk):
        low, end = max(0, at - own.longest), min(at + chunk, len(text))
        parts.append((text[low : end + own.longest], at - low, end - low))
    states = sentencepiece.borders([own.matrix(*p) for p in parts])
    return b"".join(own.trace(*p, x, y) for p, x, y in zip(parts, states[:-1], states[1:], strict=True))


def test_chunks_equal_the_whole(own):
    rng = random.Random(2)
    for text in [t for t in texts(400, 50, 3) if t] + ["y" * 200, "the " * 50]:
        assert chunked(own, text, rng.choice([1, 2, 3, 5, 8, 13, 30])) == own.encode(text).tobytes()


def test_products_are_associative(own):
    text = own.normal("thinghealinganditsothers" * 4)
    parts = [(text[max(0, a - 16) : a + 27], min(a, 16), min(a, 16) + 11) for a in range(0, len(text) - 11, 11)]
    a, b, c = (own.matrix(*p) for p in parts[1:4])
    assert sentencepiece.compose(sentencepiece.compose(a, b), c) == sentencepiece.compose(a, sentencepiece.compose(b, c))


def test_encode_with_giants(docs, none, model, library):
    table = [*ODD, (50, "z" * 3000, "a"), (51, LONG, "a")]
    got = sentencepiece.encode(docs(table), ["doc_id", "n_chars"], model, chunk=500, giant=2000)
    rows = sentencepiece.decode(got, model).collect()
    assert len(rows) == len(table)
    want = sorted((str(i), library.encode(t or "")) for i, t, _ in table)
    assert sorted((str(r.doc_id), list(r.ids)) for r in rows) == want
    assert sorted((str(r.doc_id), r.decoded) for r in rows) == sorted((str(i), t or "") for i, t, _ in table)
    assert sentencepiece.encode(none, ["doc_id"], model).count() == 0


def test_giants_through_a_tall_tree(docs, model, library, monkeypatch):
    monkeypatch.setattr(sentencepiece, "FAN", 3)
    table = [(1, LONG[:9000], "a"), (2, "q" * 2500, "a"), (3, LONG[:9000], "b"), (4, None, "a"), (5, "é漢 " * 700, "a")]
    rows = sentencepiece.encode(docs(table), ["doc_id"], model, chunk=300, giant=1000, check=True).collect()
    assert sorted((r.doc_id, list(r.ids)) for r in rows) == [(i, library.encode(t or "")) for i, t, _ in table]
    assert all(r.round_trip for r in rows)
    many = docs([(i, t, "a") for i, t in enumerate(texts(300, 20, 9))])
    own = sentencepiece.Segmenter(model)
    for r in sentencepiece.encode(many, ["doc_id", "text"], model, check=True).collect():
        assert r.round_trip == (own.decode(np.array(r.ids)) == r.text)


def grams(text):
    words = (text or "").split()
    k = min(5, len(words))
    seen, out = {}, set()
    for i in range(len(words) - k + 1 if words else 0):
        g = tuple(words[i : i + k])
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def copies(seed=4, groups=8, size=12):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, out, n = [word() for _ in range(60)], [], 100
    for g in range(groups):
        base = [word() for _ in range(120)] + passage
        for _ in range(size if g else 60):  # one larger group
            own = list(base)
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 2)
            out.append((n, " ".join(own), "s"))
            n += 1
    return out


def classes_of(table, least=0.8):
    keys = [grams(t) for _, t, _ in table]
    root = list(range(len(table)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(table)):
        for j in range(i):
            if table[i][1] == table[j][1] and keys[i] or keys[i] and keys[j] and len(keys[i] & keys[j]) >= least * len(keys[i] | keys[j]):
                root[find(i)] = find(j)
    members = {}
    for i in range(len(table)):
        members.setdefault(find(i), set()).add(table[i][0])
    return {frozenset(m) for m in members.values()}


def test_near_dedup_against_all_pairs(docs, none):
    table = copies() + [r for r in ODD if r[0] != 5]
    got = near_dedup.classes(docs(table)).collect()
    assert len(got) == len(table)
    own = {}
    for r in got:
        own.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(m) for m in own.values()} == classes_of(table)
    assert all(r.class_id == min(x for x in own[r.class_id] if x is not None) for r in got if r.class_id is not None)
    kept = near_dedup.keep_one(docs(table)).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(k) for k in own)
    assert near_dedup.classes(none).count() == 0


def test_repeated_rows_keep_one(docs):
    table = docs([(5, "a b c d e f g", "s"), (5, "a b c d e f g", "s"), (6, "a b c d e f g", "s"), (7, None, "s")])
    kept = sorted(r.doc_id for r in near_dedup.keep_one(table).collect())
    assert kept == [5, 7]


def test_no_link_is_lost_in_a_large_bucket(docs):
    """Copies of copies: many texts share sketches, few are similar to the leader."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    kept, table = [[word() for _ in range(150)]], []
    for n in range(260):
        own = list(rng.choice(kept))
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = word()
        kept.append(own)
        table.append((n, " ".join(own), "s"))
    own = {}
    for r in near_dedup.classes(docs(table)).collect():
        own.setdefault(r.class_id, set()).add(r.doc_id)
    assert {frozenset(m) for m in own.values()} == classes_of(table)


def test_components(spark):
    rng = random.Random(6)
    links = [(f"n{a}".encode(), f"n{b}".encode()) for a, b in [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]]
    got = {bytes(r.key): bytes(r.root) for r in near_dedup.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    root = {x: x for pair in links for x in pair}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert {k: v for k, v in got.items()} == {k: v for k, v in root.items() if k in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}


def test_similarity_is_exact_on_small_edits():
    a = "a b c d e f g h i j k l m n o p q r s t u v w x y z".split()
    b = [*a[:10], "new", *a[10:]]
    x, y = near_dedup.kmers(" ".join(a)), near_dedup.kmers(" ".join(b))
    assert near_dedup.similarity(x, y, 0.5) == pytest.approx(len(grams(" ".join(a)) & grams(" ".join(b))) / len(grams(" ".join(a)) | grams(" ".join(b))))
    assert near_dedup.similarity(x, x[::-1], 0.8) < 0.8


def test_classifier(spark, docs, none, odd):
    good = [(i, f"Some plain words {i} stand in this line.\nAnd here is another one of them, {i} too.", "a") for i in range(0, 120)]
    bad = [(i, f"BUY!! {i} *** NOW!! ### $$$\n%%% CHEAP!! {i} ***", "a") for i in range(200, 320)]
    labels = spark.createDataFrame([(i, int(i < 200), 0) for i, _, _ in good + bad] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    table = docs(good + bad)
    model = quality_classifier.train(table, labels)
    got = quality_classifier.score(table, model).collect()
    out = [r for r in got if r.held_out]
    assert out and sum(r.predicted == int(r.doc_id < 200) for r in out) / len(out) > 0.95
    assert all(0 <= r.score <= 1 for r in got)
    assert quality_classifier.score(odd, model).count() == len(ODD)
    assert quality_classifier.score(none, model).count() == 0
    lone = quality_classifier.train(table, labels.limit(0))
    assert quality_classifier.score(odd, lone).where(F.col("score").isNull()).count() == 0


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    emit, trans = rng.standard_normal((1, 5)), rng.standard_normal((2, 2))
    good, total, _ = quality_classifier.marginals(emit, np.array([5]), trans)
    weights = {}
    for code in range(32):
        y = [code >> i & 1 for i in range(5)]
        weights[tuple(y)] = np.exp(sum(emit[0, i] * y[i] for i in range(5)) + sum(trans[y[i], y[i + 1]] for i in range(4)))
    z = sum(weights.values())
    assert np.allclose(np.log(z), total[0])
    for i in range(5):
        assert np.allclose(good[0, i], sum(w for y, w in weights.items() if y[i]) / z)


def test_real_labels_held_out_and_lines_apart(spark):
    """On documents that training doesn't see; and within one text good and bad lines differ."""
    read = lambda name: spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet")
    docs, labels = read("documents"), read("labels")
    model = quality_classifier.train(docs, labels)
    got = quality_classifier.score(docs, model).where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id").toPandas()
    rank, good = got.score.rank(), got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc >= 0.99
    assert (got.predicted == got.quality).mean() >= 0.98
    fine = "The words of this line read like those of any other text, and it ends so."
    junk = "and*** of### the$$$ here&&& we*** that### it%%% go|| on||"
    x, _ = quality_classifier.features("\n".join([fine] * 6 + [junk] * 6))
    emit = ((x - model["mean"]) / model["scale"]) @ model["w"]
    lines = quality_classifier.marginals(emit[None, :], np.array([12]), model["trans"])[0][0]
    assert lines[:3].min() > 0.6 and lines[6:].max() < 0.4  # features of neighbours reach over the border


def test_training_takes_whole_texts():
    for n in (1, 200, 201, 1000, 12_345):
        runs = quality_classifier.chains(n)
        assert [i for r in runs for i in range(n)[r]] == list(range(n))
        assert max(r.stop - r.start for r in runs) <= quality_classifier.CHAIN
    own = np.array([3.0, -2.0, 1.0, 4.0])
    assert quality_classifier.line_labels(own, np.ones(4)).tolist() == [0.5, 0.0, 0.0, 0.5]
    assert quality_classifier.line_labels(own[:1], np.ones(1)).tolist() == [0.0]


def test_training_rows_are_bounded_by_their_lines(docs, spark):
    """A row whose lines would exceed the bound is passed over; others are learned."""
    fine, junk = "This line reads as any other one does, and it ends well.", "x*** y### z$$$ %%% && ||"
    frame = docs([(i, "\n".join([fine if i % 2 else junk] * (500 if i < 3 else 3)), "a") for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    for most_lines in (200, 2000):
        model = quality_classifier.train(frame, labels, most_lines=most_lines)
        got = {r.doc_id: r.predicted for r in quality_classifier.score(frame, model).collect()}
        assert all(got[i] == i % 2 for i in range(60))
    assert quality_classifier.score(frame.limit(0), model).count() == 0
    assert quality_classifier.train(frame, labels, most_lines=2)["w"].any()  # no row fits: the base rate
