"""License scans by a generalised suffix automaton of licence texts.

The automaton holds every run of words of all templates. A file is streamed through it once,
which gives for each word the longest run of template words that ends there (the matching
statistics); long matches are chained, template by template, into covered spans.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c

# Phrases of the base scan, and texts of well-known licences: the whole of those that
# files carry whole, and of the others the whole notice that files carry instead.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}
TEMPLATES = {
    "mit": """permission is hereby granted free of charge to any person obtaining a copy of this
        software and associated documentation files the software to deal in the software without
        restriction including without limitation the rights to use copy modify merge publish
        distribute sublicense and or sell copies of the software and to permit persons to whom the
        software is furnished to do so subject to the following conditions the above copyright
        notice and this permission notice shall be included in all copies or substantial portions
        of the software the software is provided as is without warranty of any kind express or
        implied including but not limited to the warranties of merchantability fitness for a
        particular purpose and noninfringement in no event shall the authors or copyright holders
        be liable for any claim damages or other liability whether in an action of contract tort
        or otherwise arising from out of or in connection with the software or the use or other
        dealings in the software""",
    "apache": """licensed under the apache license version 2 0 the license you may not use this
        file except in compliance with the license you may obtain a copy of the license at
        http www apache org licenses license 2 0 unless required by applicable law or agreed to
        in writing software distributed under the license is distributed on an as is basis
        without warranties or conditions of any kind either express or implied see the license
        for the specific language governing permissions and limitations under the license""",
    "gpl": """this program is free software you can redistribute it and or modify it under the
        terms of the gnu general public license as published by the free software foundation
        either version 3 of the license or at your option any later version this program is
        distributed in the hope that it will be useful but without any warranty without even the
        implied warranty of merchantability or fitness for a particular purpose see the gnu
        general public license for more details you should have received a copy of the gnu
        general public license along with this program if not see https www gnu org licenses""",
    "bsd": """redistribution and use in source and binary forms with or without modification are
        permitted provided that the following conditions are met 1 redistributions of source code
        must retain the above copyright notice this list of conditions and the following
        disclaimer 2 redistributions in binary form must reproduce the above copyright notice this
        list of conditions and the following disclaimer in the documentation and or other
        materials provided with the distribution 3 neither the name of the copyright holder nor
        the names of its contributors may be used to endorse or promote products derived from this
        software without specific prior written permission this software is provided by the
        copyright holders and contributors as is and any express or implied warranties including
        but not limited to the implied warranties of merchantability and fitness for a particular
        purpose are disclaimed in no event shall the copyright holder or contributors be liable
        for any direct indirect incidental special exemplary or consequential damages including
        but not limited to procurement of substitute goods or services loss of use data or profits
        or business interruption however caused and on any theory of liability whether in contract
        strict liability or tort including negligence or otherwise arising in any way out of the
        use of this software even if advised of the possibility of such damage""",
    "isc": """permission to use copy modify and or distribute this software for any purpose with
        or without fee is hereby granted provided that the above copyright notice and this
        permission notice appear in all copies the software is provided as is and the author
        disclaims all warranties with regard to this software including all implied warranties of
        merchantability and fitness in no event shall the author be liable for any special direct
        indirect or consequential damages or any damages whatsoever resulting from loss of use
        data or profits whether in an action of contract negligence or other tortious action
        arising out of or in connection with the use or performance of this software""",
    "zlib": """this software is provided as is without any express or implied warranty in no event
        will the authors be held liable for any damages arising from the use of this software
        permission is granted to anyone to use this software for any purpose including commercial
        applications and to alter it and redistribute it freely subject to the following
        restrictions 1 the origin of this software must not be misrepresented you must not claim
        that you wrote the original software if you use this software in a product an
        acknowledgment in the product documentation would be appreciated but is not required 2
        altered source versions must be plainly marked as such and must not be misrepresented as
        being the original software 3 this notice may not be removed or altered from any source
        distribution""",
    "mpl": """this source code form is subject to the terms of the mozilla public license v 2 0 if
        a copy of the mpl was not distributed with this file you can obtain one at http mozilla
        org mpl 2 0""",
    "cc-by": """this work is licensed under a creative commons attribution 4 0 international
        license""",
}
LONG = 5        # words of a match worth chaining
SLACK = 12      # words of the file that a chain may skip between two matches
PASSAGE = 20    # covered words that make a label
COVER = 0.5     # share of a template that makes one if that is less
FULL = 40       # covered words, or a whole template, that score 1

_TO_WORDS = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80
    else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and anything beyond ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TO_WORDS).split()


class Automaton:
    """Suffix automaton of several word sequences.

    For each state: transitions, suffix link, longest length, and for every template the end
    of the state's first occurrence there.
    """

    def __init__(self, sequences: list[list[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.ends: list[dict[int, int]] = [{}]
        for number, seq in enumerate(sequences):
            last = 0
            for at, word in enumerate(seq):
                last = self._extend(last, word)
                s = last
                while s > 0 and number not in self.ends[s]:
                    self.ends[s][number] = at + 1
                    s = self.link[s]

    def _add(self, length: int, nxt: dict[int, int], link: int, ends: dict[int, int]) -> int:
        self.next.append(nxt)
        self.len.append(length)
        self.link.append(link)
        self.ends.append(ends)
        return len(self.len) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """The state of p's longest run and then word, split off q where q holds longer ones."""
        if self.len[p] + 1 == self.len[q]:
            return q
        clone = self._add(self.len[p] + 1, dict(self.next[q]), self.link[q], dict(self.ends[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        if word in self.next[last]:
            return self._split(last, self.next[last][word], word)
        made = self._add(self.len[last] + 1, {}, 0, {})
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = made
            p = self.link[p]
        if p >= 0:
            self.link[made] = self._split(p, self.next[p][word], word)
        return made

    def statistics(self, words: list[int]) -> tuple[list[int], list[int]]:
        """Length of the longest template run ending at each word, and its state."""
        state, length = 0, 0
        lengths, states = [], []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.len[state]
            if w in self.next[state]:
                state = self.next[state][w]
                length += 1
            lengths.append(length)
            states.append(state)
        return lengths, states


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES):
        self.names = sorted(templates)
        texts = [templates[n].split() for n in self.names]
        vocabulary = sorted({w for t in [*texts, *(p.split() for p in phrases.values())]
                             for w in t})
        self.ids = {w.encode(): i for i, w in enumerate(vocabulary)}
        number = {w: i for i, w in enumerate(vocabulary)}
        sequences = [[number[w] for w in t] for t in texts]
        self.sizes = [len(s) for s in sequences]
        self.automaton = Automaton(sequences)
        self.phrases = {k: [number[w] for w in p.split()] for k, p in phrases.items()}

    def base(self, words: np.ndarray) -> dict[str, np.ndarray]:
        """Starts of each phrase's places."""
        out = {}
        for label, phrase in self.phrases.items():
            n = len(words) - len(phrase) + 1
            ok = np.ones(max(n, 0), bool)
            for i, w in enumerate(phrase):
                ok &= words[i:i + len(ok)] == w
            out[label] = np.flatnonzero(ok)
        return out

    def matches(self, words: np.ndarray) -> list[tuple[int, int, dict[int, int]]]:
        """(start, end, {template: end there}) of maximal long matches, in file order.

        Words of no template end every match, so only long runs of known words are streamed.
        """
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (words >= 0).view(np.int8), [0]])))
        out = []
        for s, e in zip(edge[::2], edge[1::2]):
            if e - s < LONG:
                continue
            lengths, states = self.automaton.statistics(words[s:e].tolist())
            for i, n in enumerate(lengths):
                if n >= LONG and (i + 1 == len(lengths) or lengths[i + 1] <= n):
                    end = int(s) + i + 1
                    out.append((end - n, end, self.automaton.ends[states[i]]))
        return out

    def spans(self, words: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(template, start, end, words covered) of chained matches."""
        open_: dict[int, list[int]] = {}
        out = []
        for start, end, where in self.matches(words):
            for t, at in where.items():
                now = open_.get(t)
                new = end - max(start, now[1]) if now else 0
                if now and start - now[1] <= SLACK and new > 0 and at > now[3]:
                    now[1], now[2], now[3] = end, now[2] + min(new, at - now[3]), at
                else:
                    if now:
                        out.append((t, *now[:3]))
                    open_[t] = [start, end, end - start, at]
        out += [(t, *now[:3]) for t, now in open_.items()]
        return sorted(out)

    def scan(self, text: str | None) -> dict:
        found = words_of(text)
        words = np.fromiter((self.ids.get(w, -1) for w in found), np.int32, len(found))
        base = self.base(words)
        places = np.sort(np.concatenate(list(base.values())))
        spans = self.spans(words)
        best = max((n / min(self.sizes[t], FULL) for t, _, _, n in spans), default=0.0)
        passages = self.passages(spans)
        base_labels = sorted(k for k, v in base.items() if len(v))
        labels = sorted({*base_labels, *(self.names[t] for t, *_ in passages)})
        return {
            "n_words": len(found), "n_base": len(places),
            "first_word": int(places[0]) if len(places) else None,
            "last_word": int(places[-1]) if len(places) else None,
            "base_labels": ",".join(base_labels), "labels": ",".join(labels),
            "score": 1.0 if base_labels else min(1.0, best),
            "spans": ",".join(f"{self.names[t]}:{s}:{e}" for t, s, e, _ in passages)}

    def passages(self, spans: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
        """Spans that are long enough, whichever part of a template they hold. Licences share
        passages: of spans that overlap, only those with the most covered words are kept."""
        long = sorted((x for x in spans if x[3] >= min(PASSAGE, COVER * self.sizes[x[0]])),
                      key=lambda x: x[1:])
        kept = [True] * len(long)
        for i, (_, _, end, n) in enumerate(long):
            j = i + 1
            while j < len(long) and long[j][1] < end:   # one of each template at most, and a few
                kept[i] &= n >= long[j][3]
                kept[j] &= long[j][3] >= n
                j += 1
        return sorted(x for x, k in zip(long, kept) if k)


_SCHEMA = ("id long, n_words long, n_base long, first_word long, last_word long, "
           "base_labels string, labels string, score double, spans string")


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text",
         templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Null and empty texts have no words, places or labels, and score 0. Rows are independent:
    repeated ones come back as often as they came, keys may be null or shared, and a very long text
    is scanned whole in one task. Other columns of docs are left out, whatever their names. A base
    phrase scores 1, else the longest passage by FULL words, or by its template if that is shorter.
    spans are label:start:end in words, of passages() of any part of a template.
    """
    tag = hashlib.md5(repr(sorted(templates.items())).encode()).hexdigest()

    def rows(cols: dict[str, pa.Array]) -> dict[str, list]:
        scanner = c.once(("licenses", tag), lambda: Scanner(templates))
        got = [scanner.scan(x) for x in cols["t"].to_pylist()]
        return {"id": cols["id"]} | {k: [g[k] for g in got] for k in (
            "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score",
            "spans")}

    found = c.map_arrow(docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")),
                        rows, _SCHEMA)
    return found.withColumnRenamed("id", key)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(c.table(spark, sf_dir, "documents"))
