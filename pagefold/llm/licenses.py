"""License scans with a generalised suffix automaton.

The words of all template texts and of the three base phrases build one suffix
automaton.  A file streams through it: after each word the automaton knows the
longest run of words, ending there, that stands in some template (the matching
statistics).  Base phrases are read off the states.  Runs of at least ``LONG``
words that no longer run contains are matches; matches of one template whose
places rise in file and template, with gaps of at most ``GAP`` words, chain
into spans, and a template whose spans cover ``SHARE`` of its words adds its
label.

The built-in templates are the full short licences and the notices by which the
long ones are put on files; ``load_templates`` reads full texts from a folder.

Words that no template uses reset the automaton, so only runs of template words
are walked one by one; the model is a few thousand states for any corpus.

Defined results: a null or empty text has no words, places or labels and scores
0; null doc_ids and repeated rows are passed through; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import in_batches, plain_words, table, texts

LONG, GAP, SHARE = 6, 12, 0.5

#: Base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Wording of public licences (label, text); several texts of a label are independent templates.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("isc", "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This program is distributed under the terms of the GNU General Public License."),
)


class SuffixAutomaton:
    """A generalised suffix automaton of sequences of words."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [(-1, -1)]  # end: a (sequence, last place) of the state

    def add(self, sequence: list[int], name: int) -> list[int]:
        """Adds one sequence; returns the states of its prefixes."""
        last, states = 0, []
        for place, c in enumerate(sequence):
            last = self._extend(last, c, (name, place))
            states.append(last)
        return states

    def _state(self, length: int, link: int, edges: dict[int, int], end: tuple[int, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.end.append(end)
        return len(self.next) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of p's longest string and c; if c leads to longer strings as well, they are split off."""
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]), self.end[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, end: tuple[int, int]) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._state(self.length[last] + 1, 0, {}, end)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new


class Scanner:
    """The automaton of templates and phrases, and what a stream of words finds in it."""

    def __init__(self, templates=TEMPLATES, phrases=PHRASES, long: int = LONG, gap: int = GAP, share: float = SHARE):
        self.long, self.gap, self.share = long, gap, share
        self.vocabulary: dict[bytes, int] = {}
        number = lambda text: [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in plain_words(text.encode())]
        self.labels = [label for label, _ in templates]
        self.sequences = [number(text) for _, text in templates]
        self.phrases = [(number(text), label) for text, label in phrases.items()]
        self.least = min([long, *(len(p) for p, _ in self.phrases)])  # no shorter run of known words can hold anything
        self.automaton = a = SuffixAutomaton()
        for k, s in enumerate([*self.sequences, *(p for p, _ in self.phrases)]):
            a.add(s, k)
        # phrases that end in each state: its own and those of its suffixes
        self.endings: list[list[int]] = [[] for _ in a.next]
        for k, (p, _) in enumerate(self.phrases):
            state = 0
            for c in p:
                state = a.next[state][c]
            self.endings[state].append(k)
        own = [list(x) for x in self.endings]
        for s in sorted(range(len(a.next)), key=a.length.__getitem__):
            if a.link[s] > 0:
                self.endings[s] = own[s] + self.endings[a.link[s]]
        # every place of each template where a state's strings end
        self.places: list[list[tuple[int, int]]] = [[] for _ in a.next]
        for k, s in enumerate(self.sequences):
            state = 0
            for place, c in enumerate(s):
                state = a.next[state][c]
                at = state
                while at > 0:
                    self.places[at].append((k, place))
                    at = a.link[at]

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Of a run of known words: (start, phrase) of base places, and (from, to, state) of long matches."""
        a, state, length = self.automaton, 0, 0
        base, matches, before = [], [], (0, 0)
        for i, c in enumerate(codes):
            while c not in a.next[state]:
                state = a.link[state]
                if state < 0:
                    state, length = 0, 0
                    break
                length = a.length[state]
            if c in a.next[state]:
                state, length = a.next[state][c], length + 1
            if before[0] >= self.long and length <= before[0]:
                matches.append((i - before[0], i, before[1]))
            before = (length, state)
            for k in self.endings[state]:
                n = len(self.phrases[k][0])
                if n <= length:
                    base.append((i - n + 1, k))
        if before[0] >= self.long:
            matches.append((len(codes) - before[0], len(codes), before[1]))
        return base, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> dict[int, list[tuple[int, list[tuple[int, int]]]]]:
        """template -> (words covered, spans of the file) of its best chain, and of each further one that reaches the share and overlaps none before; matches are in file order."""
        by: dict[int, list[tuple[int, int, int]]] = {}
        for a, b, state in matches:
            for k, place in self.places[state]:
                by.setdefault(k, []).append((a, b, place + 1 - (b - a)))
        out: dict[int, list] = {}
        for k, whole in by.items():
            left = [whole]
            while left:
                covered, where = self._chain(k, found := left.pop())
                if k in out and covered < self.share * len(self.sequences[k]):
                    continue
                out.setdefault(k, []).append((covered, where))
                first, last = where[0][0], where[-1][1]
                before = [(a, min(b, first), t) for a, b, t in found if a < first]
                after = [(max(a, last), b, t + max(a, last) - a) for a, b, t in found if b > last]
                left += [x for x in (before, after) if x]
        return out

    def _chain(self, k: int, found: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int]]]:
        """The best chain of some matches (from, to, place in the template) with template ``k``."""
        best: list[tuple[int, list]] = []
        for i, (a, b, t) in enumerate(found):
            top = (b - a, [(a, b)])
            for j in range(i - 1, -1, -1):
                a2, b2, t2 = found[j]
                if a - b2 > self.gap + len(self.sequences[k]):
                    break
                u2 = t2 + b2 - a2
                over = max(0, b2 - a, u2 - t)  # words that both would count
                if a2 < a and t2 < t and a - b2 <= self.gap and t - u2 <= self.gap and over < b - a and best[j][0] + b - a - over > top[0]:
                    top = (best[j][0] + b - a - over, [*best[j][1], (a + over, b)])
            best.append(top)
        return max(best, key=lambda x: x[0])

    def scan(self, ws: list[bytes]) -> dict:
        get = self.vocabulary.get
        t = np.fromiter((get(w, 0) for w in ws), np.int32, len(ws))
        return self.scan_codes(t)

    def scan_codes(self, t: np.ndarray) -> dict:
        """Base places (start, label), labels, score and spans (label, from, to) of a file."""
        known = t > 0
        edges = np.flatnonzero(np.diff(known, prepend=False, append=False))
        base, matches = [], []
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= self.least:
                x, y = self.stream(t[a:b].tolist())
                base += [(a + s, self.phrases[k][1]) for s, k in x]
                matches += [(a + i, a + j, s) for i, j, s in y]
        spans, labels, score = [], {label for _, label in base}, 1.0 if base else 0.0
        for k, found in self.chains(matches).items():
            for covered, where in found:
                part = min(1.0, covered / len(self.sequences[k]))
                score = max(score, part)
                if part >= self.share:
                    labels.add(self.labels[k])
                    spans += [(self.labels[k], a, b) for a, b in where]
        return {"base": base, "labels": sorted(labels), "score": score, "spans": sorted(set(spans))}


SCHEMA = "doc_id {}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first:long,last:long>>"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """n_words, base places, labels, score and covered template spans of each document."""
    sent = docs.sparkSession.sparkContext.broadcast(scanner or Scanner())
    span = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("last", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts(batch.column(1)):
                ws = plain_words(text)
                found = sent.value.scan(ws)
                at = [s for s, _ in found["base"]]
                rows.append((len(ws), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found["base"]})), ",".join(found["labels"]), found["score"], [{"label": x, "first": a, "last": b} for x, a, b in found["spans"]]))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), span)
            cols = list(zip(*rows)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, types))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"])

    return in_batches(docs.select("doc_id", F.col("text").cast("string")), run, SCHEMA.format(docs.schema["doc_id"].dataType.simpleString()))


def load_templates(spark, folder: str, most_bytes: int = 4 << 20) -> tuple[tuple[str, str], ...]:
    """(label, text) of the text files of a folder, labelled by their names without an ending; at most ``most_bytes`` together."""
    files = spark.read.format("binaryFile").load(folder)
    if (files.agg(F.sum("length")).first()[0] or 0) > most_bytes:
        raise ValueError("templates go to every task: too many bytes")
    return tuple((r.path.rpartition("/")[2].partition(".")[0].lower(), bytes(r.content).decode("utf-8", "replace")) for r in files.orderBy("path").collect())


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")


QUERIES = {"op8_license_scan": op8_license_scan}
