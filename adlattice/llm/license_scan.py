"""Licence scans with a generalised suffix automaton over words.

The automaton holds every substring of the licence templates and phrases. A document
is streamed through it word by word; at each word it gives the length of the longest
match that ends there (the matching statistics). Where long matches lie, each template
that may be there is matched on its own, so one that is part of another isn't hidden by
it; its long maximal matches, at every place of the template where they stand, are
chained in text and template order into the spans that cover most of it, and a label is
given where a chain covers enough. Phrases are found on the way: one ends at a word if
it is a suffix of the match there. A text's words are read in pieces and kept as numbers,
four bytes each.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame

from .common import map_rows

#: Fixed phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Fixed wording of public licences and notices, abridged to their telling sentences.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", "released under the mit license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    # whole texts and notices
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program"),
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("wtfpl", "do what the fuck you want to public license terms and conditions for copying distribution and modification"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
)

LEAST_MATCH = 3  # words of a match that is chained
LEAST_COVER = 0.6  # share of a template that labels a document
MOST_GAP = 8  # words between the matches of a chain

_KEEP = bytes(b for b in range(256) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
_TABLE = bytes(b if b in set(_KEEP) else (b + 32 if 0x41 <= b <= 0x5A else 0x20) for b in range(256))


PIECE = 1 << 20  # bytes of a text that are words at a time


def words(text: str | None) -> Iterator[bytes]:
    """Lower-cased words: runs of ASCII letters, digits and anything beyond ASCII."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + PIECE)
        end = len(raw) if end < 0 else end
        yield from raw[at:end].split()
        at = end


def _runs(text: array) -> Iterator[tuple[int, ...]]:
    return zip(*(text[i:] for i in range(LEAST_MATCH)), strict=False)


class Automaton:
    """A generalised suffix automaton of word sequences.

    next[s] maps a word number to a state, link[s] is the suffix link, length[s] the
    longest string of the state. ends[s] names, by template, the ends of all places of
    the state's strings; phrases[s] the (words, label) of phrases that end there. Phrases
    that stand in no template are in an automaton of their own, so that they can't hide a
    template's match. Words that aren't in ids are 0 and match nothing.
    """

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, ids: dict[bytes, int] | None = None):
        self.ids: dict[bytes, int] = {} if ids is None else ids
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        self.labels = [label for label, _ in templates]
        sequences = [[self.ids.setdefault(w, len(self.ids) + 1) for w in words(t)] for _, t in templates]
        names = [([self.ids.setdefault(w, len(self.ids) + 1) for w in words(p)], label) for p, label in phrases]
        self.sizes = [len(s) for s in sequences]
        for k, sequence in enumerate(sequences):
            last = 0
            for at, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(k, set()).add(at)
        beyond = [(p, n) for p, n in zip(phrases, names, strict=True) if self._find(n[0]) is None] if templates else []
        self.others = Automaton((), [p for p, _ in beyond], self.ids) if beyond else None
        names = [n for n in names if all(n is not m for _, m in beyond)]
        for sequence, _ in names:  # with templates, they are there already
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        order = sorted(range(1, len(self.next)), key=lambda s: self.length[s])
        for s in reversed(order):  # a suffix stands wherever the longer string does
            if self.link[s] > 0:
                for k, at in self.ends[s].items():
                    self.ends[self.link[s]].setdefault(k, set()).update(at)
        own: dict[int, list[tuple[int, str]]] = {}
        for sequence, label in names:
            own.setdefault(self._find(sequence), []).append((len(sequence), label))
        #: each template's own automaton, and the templates that hold a run of LEAST_MATCH words
        self.alone = [Automaton((t,), (), self.ids) for t in templates] if len(templates) > 1 or phrases else []
        self.holders: dict[tuple[int, ...], set[int]] = {}
        for k, sequence in enumerate(sequences if self.alone else ()):
            for run in _runs(array("i", sequence)):
                self.holders.setdefault(run, set()).add(k)
        self.phrases: list[tuple[tuple[int, str], ...]] = [()] * len(self.next)
        for s in order:
            self.phrases[s] = (*self.phrases[self.link[s]], *own.get(s, ())) if self.link[s] >= 0 else ()

    def _find(self, sequence: list[int]) -> int | None:
        """The state of a sequence, if it stands in a template."""
        s: int | None = 0
        for word in sequence:
            s = None if s is None else self.next[s].get(word)
        return s

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(link)
        self.length.append(length)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of q's strings that are no longer than p's and the word."""
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = new
            p = self.link[p]
        return new

    def _extend(self, last: int, word: int) -> int:
        if (q := self.next[last].get(word)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._state(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def numbers(self, text: str | None) -> array:
        """The text's words."""
        find = self.ids.get
        return array("i", (find(w, 0) for w in words(text)))

    def scan(self, text: array | list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Phrases (start, label), and each template's maximal matches (template, start, template
        start, words)."""
        if not isinstance(text, array):
            text = array("i", (self.ids.get(w, 0) for w in text))
        found, seeds = self._scan(text)
        if self.others:
            found += self.others._scan(text)[0]
        return found, self._each(text, seeds) if self.alone else seeds

    def _each(self, text: array, seeds: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Matches of every template on its own. They lie within the matches of all templates
        together, so only these parts of the text are read again."""
        parts: list[list[int]] = []
        for _, start, _, n in seeds:
            if parts and start < parts[-1][1]:
                parts[-1][1] = max(parts[-1][1], start + n)
            else:
                parts.append([start, start + n])
        out = []
        for start, end in parts:
            part = text[start:end]
            for k in sorted(set().union(*(self.holders.get(run, ()) for run in _runs(part)))):
                out += [(k, start + s, at, n) for _, s, at, n in self.alone[k]._scan(part)[1]]
        return out

    def _scan(self, text: array) -> tuple[list[tuple[int, str]], list[tuple[int, int, int, int]]]:
        """Phrases, and matches that are maximal over all templates together."""
        found: list[tuple[int, str]] = []
        seeds: list[tuple[int, int, int, int]] = []
        following, link, length, phrases = self.next, self.link, self.length, self.phrases
        state = matched = 0
        for at, word in enumerate(text):
            if not word:
                if matched >= LEAST_MATCH:
                    self._seed(seeds, state, matched, at)
                state = matched = 0
                continue
            step = following[state].get(word)
            if step is None:
                if matched >= LEAST_MATCH:
                    self._seed(seeds, state, matched, at)
                while step is None and state > 0:
                    state = link[state]
                    matched = length[state]
                    step = following[state].get(word)
                if step is None:  # a word of other templates only
                    matched = 0
                    continue
            state, matched = step, matched + 1
            for n, label in phrases[state]:
                if n <= matched:
                    found.append((at - n + 1, label))
        if matched >= LEAST_MATCH:
            self._seed(seeds, state, matched, len(text))
        return found, seeds

    def _seed(self, seeds: list, state: int, matched: int, end: int) -> None:
        for k, places in self.ends[state].items():
            seeds += [(k, end - matched, at - matched + 1, matched) for at in sorted(places)]

    def spans(self, seeds: list[tuple[int, int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, start, end, share of the template) of the chains that cover enough.

        A match follows another of its template if it does so in both, at most MOST_GAP
        words behind; what overlaps counts once. Of each template the chain that covers
        most comes first, and then others where none has been found before.
        """
        by: dict[int, list[tuple[int, int, int]]] = {}
        for k, start, at, n in seeds:
            by.setdefault(k, []).append((start, at, n))
        out: list[tuple[str, int, int, float]] = []
        for k, own in by.items():
            own.sort()
            best, before, first = [n for _, _, n in own], [-1] * len(own), [s for s, _, _ in own]
            low = 0  # the first match that may still be followed
            longest = max(n for _, _, n in own)
            for i, (start, at, n) in enumerate(own):
                while own[low][0] + longest + MOST_GAP < start:
                    low += 1
                for j in range(low, i):
                    end, t_end = own[j][0] + own[j][2], own[j][1] + own[j][2]
                    over = max(0, end - start, t_end - at)
                    if over < n and own[j][1] < at and start - end <= MOST_GAP and at - t_end <= MOST_GAP and best[j] + n - over > best[i]:
                        best[i], before[i], first[i] = best[j] + n - over, j, first[j]
            taken: list[tuple[int, int]] = []
            for i in sorted(range(len(own)), key=lambda i: (-best[i], own[i])):
                if best[i] < LEAST_COVER * self.sizes[k]:
                    break
                end = own[i][0] + own[i][2]
                if all(end <= a or b <= first[i] for a, b in taken):
                    taken.append((first[i], end))
                    out.append((self.labels[k], first[i], end, min(1.0, best[i] / self.sizes[k])))
        return sorted(out, key=lambda x: (x[1], x[2], x[0]))


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """doc_id and the licence columns for every row.

    A null text is empty. score is the largest share of a template that is covered,
    and at least 0.5 with a phrase. spans lists label:start:end (words, end exclusive).
    The automaton is built once from the templates, whose number bounds its size. An empty
    table gives no rows; whole texts are read, of any length, four bytes a word.
    Repeated rows give repeated results; columns other than doc_id and text are not read.
    """
    automaton = Automaton(templates, phrases)

    def run(parts: Iterator[dict[str, list]]) -> Iterator[dict[str, list]]:
        for part in parts:
            out: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans")}
            for text in part["text"]:
                tokens = automaton.numbers(text)
                base, seeds = automaton.scan(tokens)
                spans = automaton.spans(seeds) if seeds else []
                out["n_words"].append(len(tokens))
                out["n_base"].append(len(base))
                out["first_word"].append(min(s for s, _ in base) if base else None)
                out["last_word"].append(max(s for s, _ in base) if base else None)
                own = {label for _, label in base}
                out["base_labels"].append(",".join(sorted(own)))
                out["labels"].append(",".join(sorted(own | {s[0] for s in spans})))
                out["score"].append(max([0.5 if base else 0.0, *(s[3] for s in spans)]))
                out["spans"].append(",".join(f"{x}:{s}:{e}" for x, s, e, _ in spans))
            yield {"doc_id": part["doc_id"], **out}

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(
        docs.select("doc_id", "text"), run,
        f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string",
    )
