"""Operator 4: license scans by an exact set-similarity join with notice templates.

Blocks are the lines of a text and its paragraphs (runs of lines that hold a word). A block meets a
template if it holds at least `threshold` of the template's distinct words. The join is exact and
filtered: words are ordered by their frequency in the whole corpus, rarest first; a block must
share a word of the template's prefix (else too few words are left to reach the threshold), hold
enough words (length), and at the first shared word enough words must still follow on both sides
(position); what passes is verified on the whole sets. Templates are a parameter of at most
MOST_TEMPLATE_BYTES, else `scan` raises, so they are broadcast; the corpus is scanned twice, for frequencies and for the join, and shuffles only
the counts of template words.

Beside that, base phrases are found wherever their words stand consecutively.

Defined results: null and empty texts have no words and no labels; scores are 1 where a base phrase stands,
else the best containment among the pairs that meet the threshold, else 0. A block that meets several
templates equally gets all of them; words of equal frequency are ordered by their bytes. Repeated rows get equal
rows. Texts of any length are scanned whole. A null doc_id stays null. Extra columns, whatever their names, are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

THRESHOLD = 0.8
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Openings of published license notices.
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc", "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit http://creativecommons.org/licenses/by/4.0/"),
]


#: Templates beyond this aren't broadcast.
MOST_TEMPLATE_BYTES = 16 << 20


class Templates:
    """Templates over ranked words. counts: corpus counts of words; a lower rank is rarer."""

    def __init__(self, templates, threshold: float, counts: dict[bytes, int]):
        sets = [(label, set(common.words(text, common.LOWER_ALNUM))) for label, text in templates]
        vocabulary = sorted(set().union(*[s for _, s in sets]), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(vocabulary)}
        self.labels, self.words, self.need = [], [], []
        self.prefix: dict[int, list[tuple[int, int]]] = {}  # rank -> (template, position)
        for label, s in sets:
            if not s:
                continue
            ordered = sorted(self.rank[w] for w in s)
            need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
            at = len(self.labels)
            self.labels.append(label)
            self.words.append(frozenset(ordered))
            self.need.append(need)
            for position, r in enumerate(ordered[: len(ordered) - need + 1]):
                self.prefix.setdefault(r, []).append((at, position))
        self.keys = frozenset(self.prefix)
        self.least = min(self.need, default=1)

    def found(self, ranks: set[int]) -> dict[int, float]:
        """Template -> containment, of those that a block with these template words meets."""
        out: dict[int, float] = {}
        if len(ranks) < self.least or self.keys.isdisjoint(ranks):
            return out
        ordered, seen = sorted(ranks), set()
        for j, r in enumerate(ordered):
            for at, i in self.prefix.get(r, ()):
                if at in seen:
                    continue
                seen.add(at)  # the first shared word: nothing before it is shared
                need = self.need[at]
                if len(ordered) >= need and 1 + min(len(self.words[at]) - i - 1, len(ordered) - j - 1) >= need:
                    share = len(self.words[at] & ranks)
                    if share >= need:
                        out[at] = share / len(self.words[at])
        return out


def _counts(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, int]:
    """How often each word of the templates stands in the corpus; as many rows as the templates have words."""
    names = sorted(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {w: i for i, w in enumerate(names)}
        total: Counter[int] = Counter()
        for batch in common.slices(batches):
            for t in batch.column("text").to_pylist():
                total.update(map(at.get, common.tokens(t, common.LOWER_ALNUM)))
        total.pop(None, None)
        yield pa.RecordBatch.from_pydict({"i": pa.array(list(total), pa.int32()), "n": pa.array(list(total.values()), pa.int64())})

    rows = docs.select("text").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()
    return {names[r["i"]]: r["n"] for r in rows}


def _blocks(text: str) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first line, stop line, words) of each line with a word, and of each paragraph of several."""
    start, gathered = 0, []
    lines = text.encode("utf-8", "surrogatepass").split(b"\n")
    for n, line in enumerate([*lines, b""]):
        own = [w for w in line.translate(common.LOWER_ALNUM).split(b" ") if w]
        if own:
            yield n, n + 1, own
            gathered.append(own)
            continue
        if len(gathered) > 1:
            yield start, n, [w for x in gathered for w in x]
        start, gathered = n + 1, []


def _places(own: list[bytes], phrases: dict[bytes, list[tuple[tuple[bytes, ...], str]]]) -> list[tuple[int, str]]:
    out = []
    for i, w in enumerate(own):
        for parts, label in phrases.get(w, ()):
            a = i + 1 - len(parts)
            if a >= 0 and tuple(own[a : i + 1]) == parts:
                out.append((a, label))
    return out


def scan(docs: DataFrame, templates=None, threshold: float = THRESHOLD, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per document: the contract's columns, and blocks: array<struct<label, template, first_line, stop_line, containment>>."""
    templates = TEMPLATES if templates is None else templates
    if (size := sum(len(t.encode("utf-8", "surrogatepass")) for _, t in templates)) > MOST_TEMPLATE_BYTES:
        raise ValueError(f"templates of {size} bytes are too large to broadcast: at most {MOST_TEMPLATE_BYTES}")
    slim = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    vocabulary = frozenset(w for _, t in templates for w in common.words(t, common.LOWER_ALNUM))
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, threshold, _counts(slim, vocabulary)))
    by_last: dict[bytes, list[tuple[tuple[bytes, ...], str]]] = {}
    for phrase, label in (PHRASES if phrases is None else phrases).items():
        parts = tuple(common.words(phrase, common.LOWER_ALNUM))
        by_last.setdefault(parts[-1], []).append((parts, label))
    kind = pa.list_(pa.struct([("label", pa.string()), ("template", pa.int32()), ("first_line", pa.int32()), ("stop_line", pa.int32()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, lasts = shared.value, frozenset(by_last)
        get = found.rank.get
        for batch in common.slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks")}
            for t in batch.column("text").to_pylist():
                own = common.words(t, common.LOWER_ALNUM)
                distinct = set(own)
                places = [] if lasts.isdisjoint(distinct) else _places(own, by_last)
                ranks = {get(w) for w in distinct}
                ranks.discard(None)
                blocks = []
                if len(ranks) >= found.least and not found.keys.isdisjoint(ranks):
                    for a, b, block in _blocks(t):
                        mine = {get(w) for w in block}
                        mine.discard(None)
                        blocks += [{"label": found.labels[k], "template": k, "first_line": a, "stop_line": b, "containment": share} for k, share in sorted(found.found(mine).items())]
                base = {x for _, x in places}
                out["n_words"].append(len(own))
                out["n_base"].append(len(places))
                out["first_word"].append(min((a for a, _ in places), default=None))
                out["last_word"].append(max((a for a, _ in places), default=None))
                out["base_labels"].append(",".join(sorted(base)))
                out["labels"].append(",".join(sorted(base | {x["label"] for x in blocks})))
                out["score"].append(1.0 if places else max((x["containment"] for x in blocks), default=0.0))
                out["blocks"].append(blocks)
            types = dict(n_words=pa.int64(), n_base=pa.int64(), first_word=pa.int64(), last_word=pa.int64(), base_labels=pa.string(), labels=pa.string(), score=pa.float64(), blocks=kind)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(out[k], types[k]) for k in out)], names=["doc_id", *out])

    of_id = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(run, f"doc_id {of_id}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, template: int, first_line: int, stop_line: int, containment: double>>")


def oracle_sql() -> str:
    """The contract's columns in SQL, every block held against every template."""
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = lambda x: f"regexp_extract_all({low.format(x)}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    templates = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, text) in enumerate(TEMPLATES))
    phrases = ", ".join(f"('{phrase}', '{label}', {len(phrase.split())})" for phrase, label in PHRASES.items())
    return f"""
with d as (select doc_id, coalesce(text, '') as text, {words("coalesce(text, '')")} as w from documents),
t as (select id, label, list_distinct({words("text")}) as w from (values {templates}) as v(id, label, text)),
tw as (select id, unnest(w) as word from t),
line as (select doc_id, n, {words("l[n]")} as w from (select doc_id, l, unnest(range(1, len(l) + 1)) as n from (select doc_id, string_split(text, chr(10)) as l from d))),
own as (select doc_id, n, w, n - row_number() over (partition by doc_id order by n) as p from line where len(w) > 0),
bw as (
  select distinct doc_id, 'l' || n as b, unnest(w) as word from own
  union all
  select distinct doc_id, 'p' || p as b, unnest(w) as word from own
),
met as (select doc_id, b, id, count(*) as c from bw join tw on bw.word = tw.word group by doc_id, b, id),
found as (select doc_id, label, c / len(w) as share from met join t on t.id = met.id where c >= ceil({THRESHOLD} * len(w) - 1e-9)),
place as (
  select doc_id, i - 1 as i, label from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from d where list_contains(w, 'license')) as x,
  (values {phrases}) as p(phrase, label, n) where array_to_string(w[i : i + n - 1], ' ') = phrase
),
base as (select doc_id, count(*) as c, min(i) as a, max(i) as z, string_agg(distinct label, ',' order by label) as s from place group by doc_id),
every as (select doc_id, string_agg(distinct label, ',' order by label) as s from (select doc_id, label from place union select doc_id, label from found) group by doc_id),
best as (select doc_id, max(share) as share from found group by doc_id)
select d.doc_id, len(d.w) as n_words, coalesce(base.c, 0) as n_base, base.a as first_word, base.z as last_word, coalesce(base.s, '') as base_labels,
       coalesce(every.s, '') as labels, case when base.c is not null then 1.0::double else coalesce(best.share, 0)::double end as score
from d left join base on base.doc_id = d.doc_id left join every on every.doc_id = d.doc_id left join best on best.doc_id = d.doc_id
"""
