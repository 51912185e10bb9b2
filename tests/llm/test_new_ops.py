"""Source divergence, spelling variants and packing against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from adlattice.llm import divergence, packing, spelling

from .conftest import LONG, ODD

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def audited(rows, least, top):
    """The divergence contract, written down plainly: (lang, source, part, item, value, rank)."""
    counts, met, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [t.translate(LOWER) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(terms)
        met[lang].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = sorted(t for t, n in met[lang].items() if n >= least)
        sources = sorted(s for g, s in groups if g == lang)
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}  # noqa: B023

        p, q = {s: share(counts[lang, s]) for s in sources}, share(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (item, value) in enumerate(sorted(items, key=lambda x: (-x[1], x[0].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, value, rank))
    return sorted(out)


def test_divergence(spark):
    rng = random.Random(5)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}" for i in range(60)] + ["Éa", "éa", "ß"]
    rows = []
    for i in range(400):
        source = rng.choice(["s1", "s2", "s3", None, "", "só", "S"])
        rows.append((rng.choice(["en", "fr", None]), source, " ".join(rng.choice(words[: 10 + 7 * len(source or "")]).upper() if i % 3 else rng.choice(words) for _ in range(rng.randint(0, 30))) + "!x1y"))
    rows += [("de", "alone", None), ("it", "a", "x"), ("it", "b", None), ("it", "c", ""), ("fr", "none", None)]
    frame = spark.createDataFrame([(i, *r, "k", 1) for i, r in enumerate(rows)], "doc_id long, lang string, source string, text string, term string, n long")
    want = audited(rows, 5, 7)
    got = [tuple(r) for r in divergence.audit(frame, 5, 7).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert sorted(got) == want
    assert any(v == 0 for *_, v, _ in want) and len(want) > 100
    assert sorted(tuple(r) for r in divergence.audit(frame.repartition(7), 5, 7).collect()) == want


def test_divergence_flushes_and_ranges(spark, monkeypatch):
    """What tasks hold back in small portions gives the same counts and corrections."""
    rng = random.Random(6)
    rows = [("en", f"s{rng.randint(0, 5)}", " ".join(rng.choice("abcdefgh") * 2 for _ in range(9))) for _ in range(60)]
    frame = spark.createDataFrame(rows, "lang string, source string, text string")
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence, "RANGES", 5)
    assert sorted(tuple(r) for r in divergence.audit(frame, 2, 4).collect()) == audited(rows, 2, 4)


def test_divergence_of_odd_tables(odd, none):
    rows = [("en", s, t) for _, t, s in ODD]
    assert sorted(tuple(r) for r in divergence.audit(odd, 2, 50).collect()) == audited(rows, 2, 50)
    assert divergence.audit(none).count() == 0


def grouped(rows, factor=10):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in counts.items():
        close = [(-m, v) for v, m in counts.items() if v != w and abs(len(v) - len(w)) < 2 and near(v, w)]
        best = min(close) if close else (0, None)
        form = best[1] if best[1] and -best[0] >= factor * n else None
        out[w] = (form, n, len(close), -best[0] if form else None)
    rows = []
    for w, (form, n, k, m) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, m))
    return sorted(rows, key=str)


@pytest.mark.parametrize("tile", [5, 2048])
def test_spelling(spark, tile):
    rng = random.Random(9)
    base = ["abcdefg", "aaaaaaaa", "aaaaaaaaa", "ÀÉabcdé", "straßenbahn", "ÿÿÿÿÿÿÿ", "prefixes", "prefixed", "bcdefga"]
    text = []
    for w in base:
        text += [w] * rng.choice([30, 200, 4])
        for _ in range(14):
            i, c = rng.randrange(len(w)), rng.choice("abxyzéÉ")
            v = rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :]])
            text += [v] * rng.choice([1, 2, 3])
            j = rng.randrange(len(v))
            text += [v[:j] + rng.choice("abxyz") + v[j + 1 :]] * 2
    rng.shuffle(text)
    rows = [(None if i == 5 else i, rng.choice([" ", "\n", "7", "×"[:0] + "-"]).join(text[i * 40 : i * 40 + 40])) for i in range(len(text) // 40 + 1)] + [(90, None), (91, "")]
    rows += [(92, "Long" + "abc" * 5000 + " " + "long" + "abc" * 5000 + " long" + "abc" * 4999 + "ac"), (93, "long" + "abc" * 4999 + "ac")]
    rows += [(i, "rootword " * 500 + "rootworda " * 30 + "rootwordab " * 2) for i in (94, 95)]
    frame = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, word string, n long, form int")
    got = sorted((tuple(r) for r in spelling.group(frame, tile).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    want = grouped(rows)
    assert got == want
    assert sum(1 for r in want if r[1]) > 10 and any(r[2] != r[0] and r[2] != r[1] for r in want)


def test_spelling_of_odd_tables(odd, none):
    got = sorted((tuple(r) for r in spelling.group(odd).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)
    assert got == grouped([(i, t) for i, t, _ in ODD])
    assert spelling.group(none).count() == 0


def test_no_pair_is_made_twice(spark):
    words = [a + b for a in ("aaaa", "aaab", "aabb", "abbb") for b in ("aaaa", "aaaaa", "bbbb", "abab")]
    counts = spark.createDataFrame([(w.encode(), 2) for w in words], "word binary, n long")
    for tile in (2, 100):
        pairs = [(bytes(r.word), bytes(r.near)) for r in spelling.near_words(counts, tile).collect()]
        assert len(pairs) == len(set(pairs)) > 10
        assert {(b, a) for a, b in pairs} == set(pairs)


def test_encoder_gives_the_tokenizers_ids():
    own, whole = packing.encoder(open(packing.MODEL).read()), Tokenizer.from_file(str(packing.MODEL))
    rng = random.Random(3)
    letters = "abcXYZ 019'.,-_<|>\n\t\r\x0b\x1c\x85 éÉßÄ×÷µªº’“…Σς ΣσİıſŉǅＡ①½٣漢字かなé́̈̈éä😀‍ ﻿"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 25))) + rng.choice(["", "<|endoftext|>", " I'll DON'T we've"]) for _ in range(2000)]
    for text, ids in zip(texts, own.many(texts), strict=True):
        assert np.frombuffer(ids, own.kind).tolist() == whole.encode(text, add_special_tokens=False).ids
    packing_piece, packing.PIECE = packing.PIECE, 50
    try:
        assert np.frombuffer(own.ids(LONG[:5000]), own.kind).tolist() == whole.encode(LONG[:5000], add_special_tokens=False).ids
    finally:
        packing.PIECE = packing_piece


def test_packed_sequences_are_full_and_balanced():
    rng = random.Random(1)
    lengths = sorted((min(64, int(rng.paretovariate(0.7) * 3)) for _ in range(3000)), reverse=True)
    pieces, n = packed = packing.packed(lengths, 64, 1)
    assert packed == packing.packed(lengths, 64, 1)
    used, spent = Counter(), Counter()
    for i, start, length, sequence, offset in pieces:
        assert offset == used[sequence]
        used[sequence] += length
        spent[sequence] += packing.cost(length, 1)
    assert sum(used.values()) == sum(lengths) and len(used) == n
    assert all(u == 64 or u & (u - 1) == 0 for u in used.values()) and sum(u != 64 for u in used.values()) <= 6
    for i, length in enumerate(lengths):
        own = sorted(p[1:3] for p in pieces if p[0] == i)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(x for _, x in own) == length
    # fewer cuts than sequences, and without long pieces costs are near each other
    assert len(pieces) - len(lengths) <= n
    even = packing.packed([8] * 400 + [4] * 800 + [1] * 1600, 64, 1)[0]
    cost = Counter()
    for _, _, length, sequence, _ in even:
        cost[sequence] += packing.cost(length, 1)
    assert max(cost.values()) <= 1.1 * min(cost.values())


@pytest.mark.parametrize(("size", "bucket"), [(4096, 1 << 23), (64, 3000)])
def test_packing(odd, none, size, bucket, monkeypatch):
    if size < 100:
        monkeypatch.setattr(packing, "MOST", 20_000)
    rows = packing.pack(odd, size=size, bucket=bucket).withColumn("crc", F.crc32("ids")).collect()
    whole = Tokenizer.from_file(str(packing.MODEL))
    want = Counter((i, tuple([*whole.encode(t or "", add_special_tokens=False).ids, 2])) for i, t, _ in ODD)
    by = defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.crc == zlib.crc32(r.ids)
        by[r.doc_id, r.doc_tokens].append((r.start, ids))
    for (doc, ids), copies in want.items():
        # pieces of repeated rows can't be told apart: each place is covered once for each copy
        cover = Counter((r[0] + k, x) for r in by[doc, len(ids)] for k, x in enumerate(r[1]))
        assert all(cover[k, x] >= copies for k, x in enumerate(ids))
    assert sum(r.length for r in rows) == sum(len(ids) * n for (_, ids), n in want.items())
    used = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used[r.sequence_id]
        used[r.sequence_id] += r.length
    assert all(u == size or u & (u - 1) == 0 for u in used.values())
    again = packing.pack(odd.repartition(5), size=size, bucket=bucket).collect()
    key = lambda r: str((r.sequence_id, r.offset, r.doc_id, r.start, r.length))
    assert sorted(map(key, again)) == sorted(map(key, rows))
    assert packing.pack(none).count() == 0
