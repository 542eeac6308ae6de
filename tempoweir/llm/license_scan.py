"""License scans: templates with markup, compiled to token automata.

A template is plain wording with ``<<beginOptional>> ... <<endOptional>>`` for
parts that may be left out and ``<<var;name="...";match="...";words="1..4">>`` for
replaceable parts (each word must match fully).  All else is mandatory and must
match word by word.  Every template becomes a small automaton over words; texts
are entered only where a word can begin a template, and the longest accepted run
from each place counts.  A base phrase is a template without markup.

Null and empty texts have no words, no matches and score 0.  The score is the
share of a text's words that matches cover.  Repeated rows are scanned one by
one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempoweir.llm import tokens
from tempoweir.llm.common import table

# Base phrases and license wordings, as published.
BASE = (
    ("cc-by", "cc by"),
    ("gpl", "general public license"),
    ("reserved", "all rights reserved"),
)
_VERSION = '<<var;name="version";match="[0-9]+";words="1..2">>'
_HOLDERS = '<<var;name="holders";match=".+";words="1..12">>'
_BULLET = '<<beginOptional>><<var;name="bullet";match="[0-9]|[a-z]|[ivx]+">> <<endOptional>>'
_BSD_OPENS = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    f"{_BULLET}Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    f"{_BULLET}Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution. "
)
_BSD_ADVERTS = (
    f"{_BULLET}All advertising materials mentioning features or use of this software must display the following acknowledgement: "
    'This product includes software developed by <<var;name="maker";match=".+";words="1..20">> '
)
_BSD_NAMES = (
    f"{_BULLET}<<beginOptional>>Neither <<endOptional>>the name of {_HOLDERS} "
    '<<beginOptional>>nor the names of <<var;name="its";match="[a-z]+">> contributors <<endOptional>>may <<beginOptional>>not <<endOptional>>be used to '
    "endorse or promote products derived from this software without specific prior written permission. "
)
_BSD_ENDS = (
    f'THIS SOFTWARE IS PROVIDED BY {_HOLDERS} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    f"MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
    "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR "
    "PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"
)
TEMPLATES = (
    ("apache", f'Licensed under the Apache License<<beginOptional>>, (the "License")<<endOptional>>, Version {_VERSION}'),
    ("cc-by-nc", f"Licensed under <<beginOptional>>a<<endOptional>> CC BY-NC {_VERSION}"),
    ("cc-by-sa", f"Licensed under <<beginOptional>>a<<endOptional>> CC BY-SA {_VERSION}"),
    (
        "gpl-notice",
        f"<<beginOptional>>This <<var;name=\"what\";match=\"[a-z]+\">> is <<endOptional>>licensed under the <<beginOptional>>terms of the "
        f"<<endOptional>>GNU General Public License<<beginOptional>> as published by the Free Software Foundation<<endOptional>>, version {_VERSION}",
    ),
    ("mit", '<<var;name="verb";match="released|licensed|distributed">> under the <<beginOptional>>terms of the <<endOptional>>MIT License'),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files<<beginOptional>> (the "Software")<<endOptional>>, to deal in the Software without restriction, including without limitation the rights '
        "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
        "<<beginOptional>>(including the next paragraph) <<endOptional>>shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        'MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND <<beginOptional>>NON <<endOptional>><<var;name="non";match="(non)?infringement">>. '
        f"IN NO EVENT SHALL {_HOLDERS} BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE",
    ),
    ("bsd-2-text", _BSD_OPENS + _BSD_ENDS),
    ("bsd-3-text", _BSD_OPENS + _BSD_NAMES + _BSD_ENDS),
    ("bsd-4-text", _BSD_OPENS + _BSD_ADVERTS + _BSD_NAMES + _BSD_ENDS),
    (
        "copyright-line",
        'Copyright <<beginOptional>>(c) <<endOptional>><<var;name="years";match="[0-9]{4}";words="1..4">> '
        '<<var;name="holder";match=".+";words="1..6">><<beginOptional>> and contributors<<endOptional>> All rights reserved',
    ),
)

_MARK = re.compile(r"<<(.*?)>>", re.S)
MATCHES = "array<struct<label: string, start: bigint, end: bigint, base: boolean>>"


@dataclass
class Automaton:
    """Edges by state: words by hash, word patterns, and free moves to later states."""

    label: str
    base: bool
    literal: list[dict[int, int]] = field(default_factory=list)
    pattern: list[list[tuple[re.Pattern, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.literal.append({})
        self.pattern.append([])
        self.free.append([])
        return len(self.free) - 1

    def closed(self, states) -> set[int]:
        seen, todo = set(), list(states)
        while todo:
            if (s := todo.pop()) not in seen:
                seen.add(s)
                todo += self.free[s]
        return seen

    def longest(self, hashes, word, at: int, end: int) -> int:
        """End of the longest accepted run of words from ``at``; ``at`` if none."""
        states, best, last = self.closed([0]), at, len(self.free) - 1
        while at < end and states:
            h = int(hashes[at])
            after = {self.literal[s][h] for s in states if h in self.literal[s]}
            if any(self.pattern[s] for s in states):
                said = word(at)
                after |= {to for s in states for p, to in self.pattern[s] if p.fullmatch(said)}
            states, at = self.closed(after), at + 1
            if last in states:
                best = at
        return best


def _hashes(text: str) -> list[int]:
    return [int(h) for w in tokens.words(pa.array([text]), tokens.ALNUM, tokens.LOWER) for h in w.hashes]


def compile_template(label: str, text: str, base: bool = False) -> Automaton:
    """Automaton of one template; its last state accepts."""
    a = Automaton(label, base)
    at, opened = a.state(), []
    for i, part in enumerate(_MARK.split(text)):
        if i % 2 == 0:
            for h in _hashes(part):
                a.literal[at][h] = (to := a.state())
                at = to
        elif part == "beginOptional":
            opened.append(at)
            a.free[at].append(to := a.state())
            at = to
        elif part == "endOptional":
            to = a.state()
            a.free[at].append(to)
            a.free[opened.pop()].append(to)
            at = to
        elif part.startswith("var"):
            said = dict(re.findall(r'(\w+)="(.*?)"', part))
            least, _, most = said.get("words", "1").partition("..")
            pattern = re.compile(said.get("match", ".+"), re.S)
            enough = []
            for n in range(int(most or least)):
                if n >= int(least):
                    enough.append(at)
                a.pattern[at].append((pattern, to := a.state()))
                at = to
            for s in enough:
                a.free[s].append(at)
        else:
            raise ValueError(f"unknown markup {part!r}")
    if opened:
        raise ValueError(f"{label}: beginOptional without endOptional")
    if len(a.free) - 1 in a.closed([0]):
        raise ValueError(f"{label}: no mandatory wording")
    return a


def _entries(a: Automaton) -> tuple[set[int], list[re.Pattern]]:
    states = a.closed([0])
    return {h for s in states for h in a.literal[s]}, [p for s in states for p, _ in a.pattern[s]]


def _scanner(base, templates):
    def scan(batches):
        automata = [compile_template(*x, base=True) for x in base] + [compile_template(*x) for x in templates]
        first = [_entries(a) for a in automata]
        # a template that opens with a replaceable word is entered at the word that follows it
        known = np.unique(np.array([h for hs, _ in first for h in hs] or [0], np.uint64))
        second = {}
        for k, a in enumerate(automata):
            for s in a.closed([0]):
                for _, to in a.pattern[s]:
                    second.setdefault(k, set()).update(h for x in a.closed([to]) for h in a.literal[x])
        after = np.unique(np.array([h for hs in second.values() for h in hs] or [0], np.uint64))
        for batch in batches:
            n_words, matches, scores = [], [], []
            for w in tokens.words(batch.column("text"), tokens.ALNUM, tokens.LOWER):
                n, starts = len(w.hashes), tokens.word_starts(w)
                found: dict[int, list[dict]] = {}
                hit = np.isin(w.hashes, known)
                hit[:-1] |= np.isin(w.hashes[1:], after)

                def word(i, w=w):
                    return w.data[w.starts[i] : w.ends[i]].tobytes().decode().translate(_FOLD)

                for i in np.flatnonzero(hit):
                    d, h = int(w.doc[i]), int(w.hashes[i])
                    end = int(starts[d] + w.counts[d])
                    follows = int(w.hashes[i + 1]) if i + 1 < n else None
                    for k, a in enumerate(automata):
                        if h in first[k][0] or follows in second.get(k, ()):
                            if (to := a.longest(w.hashes, word, int(i), end)) > i:
                                lo = int(starts[d])
                                found.setdefault(d, []).append({"label": a.label, "start": int(i) - lo, "end": to - lo, "base": a.base})
                for d in range(w.hi - w.lo):
                    own = found.get(d, [])
                    covered = np.zeros(w.counts[d] if own else 0, bool)
                    for m in own:
                        covered[m["start"] : m["end"]] = True
                    matches.append(own)
                    scores.append(covered.mean() if own else 0.0)
                n_words.append(w.counts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.concatenate(n_words) if n_words else [], pa.int64()),
                    pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))),
                    pa.array(scores, pa.float64()),
                ],
                ["doc_id", "n_words", "matches", "score"],
            )

    return scan


_FOLD = {c: c + 32 for c in range(0x41, 0x5B)}


def scan_licenses(docs: DataFrame, base=BASE, templates=TEMPLATES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, matches (label, first word, end, base) and score of every text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(_scanner(base, templates), f"doc_id {kind}, n_words bigint, matches {MATCHES}, score double")


def digest(scanned: DataFrame) -> DataFrame:
    """The matches of ``scan_licenses`` as counts, places and label lists."""
    own = F.filter("matches", lambda m: m["base"])
    names = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(own).cast("long").alias("n_base"),
        F.array_min(F.transform(own, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(own, lambda m: m["start"])).alias("last_word"),
        names(own).alias("base_labels"),
        names(F.col("matches")).alias("labels"),
        "score",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(scan_licenses(table(spark, sf_dir, "documents")))


QUERIES = {"op7_license_scan": op7_license_scan}
#: The method's labels and score need automata; tests hold the query against brute force.
ORACLE: dict[str, str] = {}
