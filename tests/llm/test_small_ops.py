"""Operators that work row by row or by counts, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from adlattice.llm import license_scan, line_dedup, mixing, near_dedup, pii, quality_rules, sharding

from .conftest import LONG, ODD


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_permutation_is_a_bijection_with_an_inverse():
    for n in (1, 2, 3, 10, 257, 1000):
        p = sharding.permute(np.arange(n), n, 7)
        assert sorted(p.tolist()) == list(range(n))
        for x in (0, n // 2, n - 1):
            assert sharding.locate(int(p[x]) % 8, int(p[x]) // 8, n, 8, 7) == x


def test_sharding(odd, none):
    got = rows(sharding.shard_documents(odd))
    assert len(got) == len(ODD)
    by = Counter(r["shard"] for r in got)
    assert max(by[s] for s in range(8)) - min(by[s] for s in range(8)) <= 1
    for s in by:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(by[s]))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ODD)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    again = rows(sharding.shard_documents(odd.repartition(5)))
    key = lambda r: tuple((v is None, v) for v in r.values())
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert sharding.shard_documents(none).count() == 0


def water(sizes, weights, most=3):
    """Shares by weight, stopped at most times the size, reshared until none is above."""
    total, target, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                target[i] = unit * weights[i]
            return target
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        open_ -= over
    return target


def test_mixing(docs, odd, none):
    table = docs([(i, "w " * (1 + i % 17), f"s{i % 5}") for i in range(200)] + [(500 + i, "v " * 400, "s9") for i in range(20)] + list(ODD))
    got = rows(mixing.assign(table))
    size = Counter()
    for r in got:
        size[r["source"]] += r["size"]
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    want = dict(zip(names, water([size[s] for s in names], [(5, 2, 1)[i % 3] for i in range(len(names))]), strict=True))
    taken = Counter()
    for r in got:
        assert r["source_size"] == size[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s in names:
        assert abs(taken[s] - want[s]) <= 1
    assert len(got) == table.count()
    assert mixing.assign(none).count() == 0
    mix = rows(mixing.mixed_documents(table))
    words = Counter()
    for r in mix:
        words[r["source"]] += len(r["text"].split())
    assert all(words[s] == taken[s] for s in names)
    assert mixing.mixed_documents(none).count() == 0


def test_curriculum_position_inverts_the_demand(spark):
    t = [i / 50 for i in range(51)]
    for slope in (-0.9, -0.3, 0.0, 0.3, 0.9):
        data = spark.createDataFrame([(x, x + slope * (x * x - x)) for x in t], "t double, share double")
        got = data.select("t", mixing.demand_inverse(F.col("share"), F.lit(slope)).alias("u")).collect()
        assert all(abs(r.t - r.u) < 1e-9 for r in got)


def plain_dedup(table):
    strip = "\x20\x09\x0a\x0b\x0c\x0d"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(strip))
    texts = [(i, (t or "").split("\n")) for i, t, _ in table]
    held = {}
    for n, (i, lines) in enumerate(texts):
        for line in lines:
            if len(key(line)) >= 40:
                held.setdefault(key(line), {})[n] = i
    keeper = {k: max(v.values(), key=lambda i: (i is not None, i)) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, lines in texts:
        kept = [x for x in lines if key(x) not in keeper or keeper[key(x)] == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup_in_both_forms(odd, none, monkeypatch):
    order = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    want = sorted(plain_dedup(ODD), key=order)
    take = lambda: sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows(line_dedup.dedup_lines(odd).select("doc.doc_id", "n_lines", "n_dropped", "kept_text"))), key=order)
    assert take() == want
    monkeypatch.setattr(line_dedup, "MOST_BROADCAST", 0)  # confirmed lines are joined
    assert take() == want
    assert line_dedup.dedup_lines(none).count() == 0


def test_full_filters_only_add_suspects(odd, monkeypatch):
    monkeypatch.setattr(line_dedup, "filter_bits", lambda n: line_dedup.SEGMENT)
    got = line_dedup.dedup_lines(odd).agg(F.sum("n_dropped")).first()[0]
    assert got == sum(x[2] for x in plain_dedup(ODD))


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(grams)
    cover = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cover))


def test_quality_rules(docs, none):
    table = [*ODD, (20, "a b c d e f g h " * 4, "a"), (21, "x | y | z | " * 12, "a"), (22, "Good words stand here. " + " ".join(f"v{i}" for i in range(30)) + ".", "a"), (23, "Fine text " + " ".join(f"u{i}" for i in range(40)) + ".\nAll rights reserved.", "b")]
    got = rows(quality_rules.judge(docs(table)))
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == Counter((i, *plain_quality(t)) for i, t, _ in table)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert kept[22] and kept[23] and not kept[21] and not kept[20] and not kept[1]
    clean = {r["doc_id"]: r for r in rows(quality_rules.clean(docs(table)))}
    assert "All rights" not in clean[23]["text"] and clean[23]["n_chars"] == len(clean[23]["text"])
    assert set(clean) == {i for i, k in kept.items() if k}
    assert quality_rules.clean(none).count() == 0


BASE = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def plain_pii(text):
    out = []
    for k, (kind, pattern) in enumerate(BASE):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True,
                "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and pii.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in sorted(out))


def test_pii_on_random_texts(docs, none):
    rng = np.random.default_rng(3)
    bits = ["a@b.co", "@", ".", "x_y%z@q-r.s.t", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+1 (234) 555-0199", "+", "-", " ", "12", "é", "a.b@", "0.0.0.0", "\n", "()"]
    texts = ["".join(rng.choice(bits, rng.integers(0, 12))) for _ in range(300)] + ["", None, "x" * 100_000, "1" * 50_000, "a@" * 20_000, "1.2.3" * 5000, "+1" * 9000]
    table = [(i, t, "a") for i, t in enumerate(texts)]
    for r in rows(pii.scan(docs(table))):
        want = plain_pii(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), texts[r["doc_id"]]
    assert pii.scan(none).count() == 0


def test_pii_extra_kinds():
    text = 'iban DE89 3704 0044 0532 0130 00 and token = "0123456789abcdef0123"'
    kinds = [pii.KINDS[s[1]] for s in pii.find(text)]
    assert "iban" in kinds and "secret" in kinds
    assert "[secret]" in pii.redact(text) and pii.redact(None) is None
    assert not any(pii.KINDS[s[1]] == "iban" for s in pii.find("DE88 3704 0044 0532 0130 00"))


def test_pii_ibans_before_upper_case_words():
    found = lambda text: [text[s:e] for s, k, e, _ in pii.find(text) if pii.KINDS[k] == "iban"]
    for iban in ("DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO93 8601 1117 947", "MT84 MALT 0110 0001 2345 MTLC AST0 01S"):
        for after in ("", ".", " EUR 500", " BIC COBADEFF", " I think", " A B C D E F G H I J K L M N O P", " " + iban):
            assert found(iban + after)[0] == iban
        for before in ("AB12 CD34 ", "XX00 ABCD EFGH ", "BIC COBADEFF "):
            assert found(before + iban + " EUR 5")[-1] == iban
        assert found(f"{iban} {iban} EUR {iban}") == [iban] * 3
    # a country that isn't listed, and ends within a token
    digits = next(f"{i:02d}" for i in range(2, 99) if pii.mod97(f"ZZ{i:02d}ABCD1234567890"))
    assert found(f"ZZ{digits} ABCD 1234 5678 90 OK") == [f"ZZ{digits} ABCD 1234 5678 90"]
    assert found("DE89370400440532013000EUR") == [] == found("xDE89370400440532013000")


def test_pii_whole_long_secrets():
    token = "aB3_" * 5000
    assert pii.redact(f"token={token} end") == "token=[secret] end"


def plain_phrases(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    found = [(i, label) for p, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    return len(words), sorted(found)


def test_license_scan(docs, none):
    rng = np.random.default_rng(5)
    bits = ["mit", "MIT", "license", "License,", "apache", "general", "public", "the", "gnu", "é", "under", "2.0"]
    texts = [" ".join(rng.choice(bits, rng.integers(0, 25))) for _ in range(200)] + [None, "", LONG, license_scan.TEMPLATES[0][1].title(), "mit license " * 3000]
    got = {r["doc_id"]: r for r in rows(license_scan.scan(docs([(i, t, "a") for i, t in enumerate(texts)])))}
    for i, t in enumerate(texts):
        n, found = plain_phrases(t)
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (n, len(found))
        assert r["first_word"] == (found[0][0] if found else None) and r["last_word"] == (found[-1][0] if found else None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert got[203]["labels"] == "mit" and got[203]["score"] == 1.0
    assert license_scan.scan(none).count() == 0


def test_automaton_finds_longest_matches():
    automaton = license_scan.Automaton((("x", "a b c d e"), ("y", "c d f g")), (("b c", "z"),))
    found, seeds = automaton.scan(b"q a b c d f g".split())
    assert found == [(2, "z")]
    assert (0, 1, 0, 4) in seeds and (1, 3, 0, 4) in seeds


def test_templates_within_others(docs):
    notice = 'Licensed under the Apache License, Version 2.0'
    texts = [f'{notice} (the "License")', f"{notice} the end", f"See. {notice} the License you may not use this. {notice}", notice]
    got = {r["doc_id"]: r for r in rows(license_scan.scan(docs([(i, t, "a") for i, t in enumerate(texts)])))}
    assert [got[i]["score"] for i in range(4)] == [1.0] * 4
    assert [got[i]["spans"] for i in (0, 1, 3)] == ["apache:0:8"] * 3
    assert "apache:1:9" in got[2]["spans"].split(",") and "apache:16:24" in got[2]["spans"].split(",")


def test_each_template_is_matched_as_if_alone():
    rng = np.random.default_rng(11)
    for _ in range(300):
        templates = tuple((f"t{k}", " ".join(rng.choice(list("abcd"), rng.integers(3, 12)))) for k in range(4))
        text = " ".join(rng.choice([*"abcd", "x"], rng.integers(0, 40), p=[0.24] * 4 + [0.04])).encode().split()
        every = license_scan.Automaton(templates, ((" ".join(rng.choice(list("abcd"), 6)), "p"),))
        want = [(k, *seed[1:]) for k, t in enumerate(templates) for seed in license_scan.Automaton((t,), ()).scan(text)[1]]
        assert sorted(every.scan(text)[1]) == sorted(want)
        # the longest match of a template is never shorter than by brute force
        for k, (_, t) in enumerate(templates):
            t = t.encode().split()
            longest = max((n for n in range(3, len(t) + 1) for i in range(len(t) - n + 1) for j in range(len(text) - n + 1) if text[j : j + n] == t[i : i + n]), default=0)
            assert max((n for m, _, _, n in every.scan(text)[1] if m == k), default=0) == longest


CLASHES = ("row", "verdict", "words", "_words", "_text", "_clean", "_kept", "_d", "_key", "key", "left", "place", "size", "kept_text", "doc", "nth", "epoch", "cut_text")


def test_names_of_columns_never_clash(spark):
    """Columns with the names of helper columns pass unharmed through what the pipeline calls."""
    text = lambda i: " ".join(f"t{i}w{k}" for k in range(30)) + "."
    frame = spark.createDataFrame([(i, text(i), "a", *(f"{c}{i}" for c in CLASHES)) for i in range(8)], "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHES))
    for stage in (quality_rules.clean, line_dedup.documents, near_dedup.keep_one, mixing.mixed_documents):
        got = stage(frame)
        assert got.columns == frame.columns
        rows = {r.doc_id: r for r in got.collect()}
        assert set(rows) == set(range(8))
        assert all(r[c] == f"{c}{i}" for i, r in rows.items() for c in CLASHES)
    judged = quality_rules.judge(frame).first()
    assert judged["_words"] == f"_words{judged.doc_id}" and judged["left"] == f"left{judged.doc_id}"


def test_quality_phrases_of_four_languages(docs):
    long = " ".join(f"w{i}" for i in range(40)) + "."
    lines = ["Mehr lesen über uns", "Tous droits réservés", "Haga clic aquí", "Zum Inhalt springen", "Click here", "S'inscrire", "ein Satz, der bleibt."]
    got = quality_rules.judge(docs([(1, "\n".join([*lines, long]), "a")])).first()
    assert got.clean_text == f"ein Satz, der bleibt.\n{long}" and got.n_removed_lines == 6


def test_quality_phrases_fold_all_letters(docs):
    """Capitals with accents too, as the SQL twin does; a longer word is another one."""
    import duckdb

    long = " ".join(f"w{i}" for i in range(40)) + "."
    for line in ("NÄCHSTE SEITE", "MENÚ PRINCIPAL", "POLÍTICA DE PRIVACIDAD", "Abonnez-Vous À", "next pageé ok", "sign in", "SIGN INÉS x", "read more_x"):
        text = f"{line}\n{long}"
        got = quality_rules.judge(docs([(1, text, "a")])).first()
        documents = docs([(1, text, "a")]).toPandas()  # noqa: F841
        bad = duckdb.sql(f"SELECT regexp_matches('{line}', '{quality_rules._sql(quality_rules.NAVIGATION)}') OR regexp_matches('{line}', '{quality_rules._sql(quality_rules.BOILERPLATE)}')").fetchall()[0][0]
        assert got.n_removed_lines == int(bad), line
        assert bad == (line not in ("next pageé ok", "SIGN INÉS x", "read more_x")), line


def test_licence_passages_that_repeat_in_a_template():
    """A passage at two places of a template is chained at the place that fits."""
    template = "a b c d x y z a b c d q r s"
    automaton = license_scan.Automaton((("t", template),), ())
    text = "y z a b c d q r s"  # the second of both places
    (span,) = automaton.spans(automaton.scan(text.encode().split())[1])
    assert span == ("t", 0, 9, 9 / 14)
    text = "a b c d k x y z a b c d q r s o o o a b c d x y z a b c d q r s"
    assert [s[:3] for s in automaton.spans(automaton.scan(text.encode().split())[1])] == [("t", 0, 15), ("t", 18, 32)]


def test_licence_words_come_in_pieces(monkeypatch):
    text = "MIT License, é漢 x " * 50
    whole = list(license_scan.words(text))
    monkeypatch.setattr(license_scan, "PIECE", 7)
    assert list(license_scan.words(text)) == whole and len(whole) == 200
