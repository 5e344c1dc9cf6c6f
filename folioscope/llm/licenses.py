"""License scans by template markup compiled to token automata."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from folioscope.llm.common import id_and_text, sliced_texts

#: Phrases of the base scan and their labels (fixed values).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Disclaimers that several licenses share (fixed values: public license texts).
BSD_DISCLAIMER = """
    This software is provided by <<var:14>> as is and any express or implied warranties, including, but not limited to, the implied warranties of
    merchantability and fitness for a particular purpose are disclaimed. In no event shall <<var:14>> be liable for any direct, indirect, incidental,
    special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or
    profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including
    negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.
"""
BSD_CONDITIONS = """
    Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
    <<var:2>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
    <<var:2>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
    documentation and/or other materials provided with the distribution.
"""
#: Templates in license markup: <<opt>> ... <<end>> may be missing, <<var:n>> stands for up to n words of any kind; case and
#: punctuation do not count (fixed values: public license texts and the notices that their authors ask for).
TEMPLATES = {
    "apache-2.0-notice": "<<opt>>this work is<<end>> licensed under the Apache License <<opt>>Version 2.0<<end>>",
    "apache-2.0": """
        Licensed under the Apache License, Version 2.0 (the "License"); you may not use <<var:4>> except in compliance with the License. You may obtain a
        copy of the License at <<var:8>> Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on
        an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing
        permissions and limitations under the License.""",
    "gpl-notice": "<<opt>>this work is<<end>> licensed under the GNU General Public License <<opt>>version <<var:3>><<end>>",
    "gpl": """
        <<var:4>> is free software <<opt>>:<<end>> you can redistribute it and/or modify it under the terms of the GNU <<opt>>Lesser<<end>> <<opt>>Affero<<end>> General Public
        License as published by the Free Software Foundation <<opt>>;<<end>> either version <<var:4>> of the License, or (at your option) any later version.
        <<opt>><<var:4>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or
        FITNESS FOR A PARTICULAR PURPOSE. See the GNU <<opt>>Lesser<<end>> <<opt>>Affero<<end>> General Public License for more details.<<end>>""",
    "cc-by-notice": "<<opt>>this work is<<end>> licensed under <<opt>>a<<end>> CC BY <<opt>>NC<<end>> <<opt>>SA<<end>> <<opt>>ND<<end>> <<var:2>>",
    "cc-by-deed": "<<opt>>this work is<<end>> licensed under a Creative Commons Attribution <<opt>>NonCommercial<<end>> <<opt>>ShareAlike<<end>> <<opt>>NoDerivatives<<end>> <<var:2>> <<opt>>International<<end>> License",
    "mit": """
        Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense,
        and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
        copyright notice and this permission notice <<opt>>(including the next paragraph)<<end>> shall be included in all copies or substantial portions of the Software.
        <<opt>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
        FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
        LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE.<<end>>""",
    "mit-notice": "<<opt>>this work is<<end>> <<opt>>released<<end>> licensed under the MIT License",
    "isc": """
        Permission to use, copy, modify, and <<opt>>/or<<end>> distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies.
        <<opt>>THE SOFTWARE IS PROVIDED "AS IS" AND <<var:6>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
        AND FITNESS. IN NO EVENT SHALL <<var:6>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS
        OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
        OF THIS SOFTWARE.<<end>>""",
    "bsd-2-clause": f"{BSD_CONDITIONS} <<opt>>{BSD_DISCLAIMER}<<end>>",
    "bsd-3-clause": f"""{BSD_CONDITIONS}
        <<var:2>> Neither the name of <<var:14>> nor the names of its contributors may be used to endorse or promote products derived from this software without specific
        prior written permission. <<opt>>{BSD_DISCLAIMER}<<end>>""",
    "zlib": """
        This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of
        this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
        freely, subject to the following restrictions: <<var:1>> The origin of this software must not be misrepresented; you must not claim that you wrote the original
        software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. <<var:1>> Altered source
        versions must be plainly marked as such, and must not be misrepresented as being the original software. <<var:1>> This notice may not be removed or altered from
        any source distribution.""",
    "unlicense": """
        This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
        either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that
        recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this
        dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment
        in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
        IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE
        LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
        THE USE OR OTHER DEALINGS IN THE SOFTWARE. <<opt>>For more information, please refer to <<var:4>><<end>>""",
    "boost": """
        <<opt>>Distributed under the Boost Software License, Version 1.0.<<end>> Permission is hereby granted, free of charge, to any person or organization obtaining a copy of
        the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and
        to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:
        The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included
        in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of
        machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED,
        INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT
        HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
        CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mpl-2.0": """
        This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at
        <<var:8>>""",
    "copyright-reserved": "copyright <<opt>>(c)<<end>> <<var:12>> all rights reserved",
}

#: Bytes of words stay, ASCII letters in lower case; every other ASCII byte parts words.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8").translate(_WORDS).split()


@dataclass
class Automaton:
    """States 0 to last. step[s]: word -> next state; any_word[s]: next state for any word; free[s]: states reached by no word."""

    step: list[dict[bytes, int]] = field(default_factory=lambda: [{}])
    any_word: list[list[int]] = field(default_factory=lambda: [[]])
    free: list[list[int]] = field(default_factory=lambda: [[]])
    anchor: bytes = b""
    before: int = 0

    def state(self) -> int:
        for x, new in ((self.step, {}), (self.any_word, []), (self.free, [])):
            x.append(new)
        return len(self.step) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def longest(self, words: list[bytes], start: int) -> int:
        """End of the longest accepted run of words from start; -1 if there is none."""
        last = len(self.step) - 1
        states, end, at = self.closure({0}), -1, start
        while states:
            if last in states:
                end = at
            if at >= len(words):
                break
            w = words[at]
            states = self.closure({self.step[s][w] for s in states if w in self.step[s]} | {x for s in states for x in self.any_word[s]})
            at += 1
        return end


def compile_template(markup: str) -> Automaton:
    """Automaton of a template, whose words are those of a text; its anchor is the longest run of mandatory words."""
    a = Automaton()
    now, opened, run, runs, most = 0, [], [], [], 0
    runs_before = 0
    for part in re.findall(r"<<opt>>|<<end>>|<<var:\d+>>|[^<\s]+", markup):
        if part == "<<opt>>":
            opened.append(now)
            runs, run = [*runs, (run, runs_before)], []
        elif part == "<<end>>":
            join = a.state()
            a.free[now].append(join)
            a.free[opened.pop()].append(join)
            now = join
            runs_before, run = most, []
        elif part.startswith("<<var"):
            n = int(part[6:-2])
            runs, run = [*runs, (run, runs_before)], []
            first, chain = now, [now]
            for _ in range(n):
                s = a.state()
                a.any_word[now].append(s)
                chain.append(s)
                now = s
            join = a.state()
            for s in chain:
                a.free[s].append(join)
            now, most = join, most + n
            runs_before = most
        for word in [] if part.startswith("<<") else words_of(part):
            s = a.state()
            a.step[now][word] = s
            now = s
            if not opened:
                if not run:
                    runs_before = most
                run = [*run, word]
            most += 1
    runs.append((run, runs_before))
    if not any(r for r, _ in runs):
        raise ValueError("a template needs a mandatory word")
    best, before = max(runs, key=lambda x: len(b" ".join(x[0])))
    a.anchor, a.before = b" " + b" ".join(best) + b" ", before
    return a


def _starts(joined: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase (with a space at both ends) stands in words that are joined likewise."""
    out, at = [], joined.find(phrase)
    words, seen = 0, 0
    while at >= 0:
        words += joined.count(b" ", seen, at)
        seen = at
        out.append(words)
        at = joined.find(phrase, at + 1)
    return out


def matches(automaton: Automaton, words: list[bytes], joined: bytes) -> list[tuple[int, int]]:
    """Longest accepted runs (start, end) of words that hold the anchor, leftmost first, none inside the one before."""
    out: list[tuple[int, int]] = []
    tried = -1
    for at in _starts(joined, automaton.anchor):
        for start in range(max(tried + 1, at - automaton.before, out[-1][1] if out else 0), at + 1):
            tried = start
            end = automaton.longest(words, start)
            if end > at:
                out.append((start, end))
                break
    return out


def scan_text(text: str, automata: dict[str, Automaton], phrases: dict[str, str]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, spans of one text."""
    words = words_of(text)
    joined = b" " + b" ".join(words) + b" " if words else b""
    base, spans, found = [], [], []
    for phrase, label in phrases.items():
        for at in _starts(joined, f" {phrase} ".encode()):
            base.append((at, label))
            spans.append((at, at + phrase.count(" ") + 1, label))
    for label, automaton in automata.items():
        if automaton.anchor in joined:
            found += [(a, b, label) for a, b in matches(automaton, words, joined)]
    covered, end = 0, 0
    for a, b, _ in sorted([*spans, *found]):
        covered += max(0, b - max(a, end))
        end = max(end, b)
    starts = [at for at, _ in base]
    base_labels = sorted({x for _, x in base})
    labels = sorted({*base_labels, *(x for _, _, x in found)})
    return len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(base_labels), ",".join(labels), covered / len(words) if words else 0.0, ",".join(f"{x}:{a}:{b}" for a, b, x in sorted([*spans, *found]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans of every row.

    A null or empty text has no words, null first_word and last_word, empty labels and score 0.
    Score: share of the words that lie in a base phrase or an accepted template. An empty table gives
    no rows; null doc_ids and repeated rows stay, other columns are not read, texts are scanned whole and without a shuffle.
    """
    templates, phrases = templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automata = {label: compile_template(t) for label, t in templates.items()}
        for ids, texts in sliced_texts(batches, 4 << 20):
            rows = [(i, *scan_text(t, automata, phrases)) for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
