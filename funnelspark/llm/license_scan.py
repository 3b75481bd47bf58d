"""Licence scan by a positional index of the rarest licence words.

Templates are notices as licensors word them, each with key phrases that it can't do without.  The index holds,
for every template, its two rarest key words (by inverse document frequency over all documents) with their
positions in the notice.  A file's words that are in the index are the rarest licence words it has; each
occurrence at ``f`` of a word that stands at ``p`` in a template says that the notice would begin near ``f - p``, and
the two postings of a template are intersected by that relative position.  What is left is verified: every key
phrase stands word by word within ``SLACK`` words of its place, and ``MIN_COVER`` of the template's words stand
within ``SLACK`` of theirs, so that notices with a few words put in, left out or exchanged are found.  As both
words belong to key phrases, the index loses no notice that the check of every position would find.

Words are runs of characters other than ASCII non-alphanumerics, with A-Z in lower case.  Besides, three
base phrases are looked for word by word, whatever the templates.

One pass over the documents counts the document frequencies (one row per licence word and task), a second one
looks up; a task holds one batch of texts, and nothing that grows with the corpus reaches the driver.

Defined cases: a null or empty text has no words, no labels and score 0; very long texts are searched whole;
notices that overlap are all found; equally rare words are taken by word, then position; rows with equal ids
are judged each on their own text; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Words by which a part of a notice may be off its place, and the share of a notice's words that must be there.
SLACK = 2
MIN_COVER = 0.75

#: Base phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Label, notice, key phrases.
TEMPLATES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3", ("affero general public license", "version 3")),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "version 2 0")),
    ("apache-2.0", "SPDX-License-Identifier: Apache-2.0", ("license identifier apache 2 0",)),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met", ("redistribution and use in source and binary forms", "conditions are met")),
    ("bsd-2-clause", "SPDX-License-Identifier: BSD-2-Clause", ("license identifier bsd 2 clause",)),
    ("bsd-3-clause", "SPDX-License-Identifier: BSD-3-Clause", ("license identifier bsd 3 clause",)),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license", "version 1 0")),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", ("commons attribution noncommercial 4 0",)),
    ("cc-by-nc-nd-4.0", "Licensed under CC BY-NC-ND 4.0", ("cc by nc nd 4 0",)),
    ("cc-by-nc-sa-4.0", "Licensed under CC BY-NC-SA 4.0", ("cc by nc sa 4 0",)),
    ("cc-by-nd-4.0", "Licensed under CC BY-ND 4.0", ("cc by nd 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License", ("commons attribution sharealike 4 0",)),
    ("cc0-1.0", "CC0 1.0 Universal", ("cc0 1 0",)),
    ("epl-2.0", "Eclipse Public License v 2.0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license", "version 2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license", "version 3")),
    ("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the "
                "License, or (at your option) any later version", ("gnu general public license", "version 2", "any later version")),
    ("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the "
                "License, or (at your option) any later version", ("gnu general public license", "version 3", "any later version")),
    ("gpl-2.0", "SPDX-License-Identifier: GPL-2.0", ("license identifier gpl 2 0",)),
    ("gpl-3.0", "SPDX-License-Identifier: GPL-3.0", ("license identifier gpl 3 0",)),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
     ("permission to use copy modify", "without fee is hereby granted")),
    ("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("mit", "Released under the MIT License", ("mit license",)),
    ("mit", "SPDX-License-Identifier: MIT", ("license identifier mit",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction",
     ("permission is hereby granted free of charge", "deal in the software without restriction")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
     ("source code form", "mozilla public license")),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable",
     ("provided as is without any express or implied warranty",)),
)

#: Bytes of words as they are (A-Z in lower case), all other ASCII as spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def file_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORD_BYTES).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[int, tuple[bytes, ...]], ...]  # with their first positions

    @property
    def keys(self) -> set[tuple[bytes, int]]:
        """Key words with their positions."""
        return {(w, p + k) for p, phrase in self.phrases for k, w in enumerate(phrase)}


def template(label: str, notice: str, phrases: tuple[str, ...]) -> Template:
    own = tuple(file_words(notice.encode()))
    placed = []
    for phrase in phrases:
        p = tuple(file_words(phrase.encode()))
        at = [i for i in range(len(own) - len(p) + 1) if own[i:i + len(p)] == p]
        if not p or not at:
            raise ValueError(f"{phrase!r} isn't in the notice {notice!r}")
        placed.append((at[0], p))
    return Template(label, own, tuple(placed))


def templates(entries=TEMPLATES) -> list[Template]:
    return [template(*e) for e in entries]


def _texts(batches: Iterator, column: str) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    for batch in batches:
        yield batch, batch.column(column).cast(pa.binary()).to_pylist()


def document_frequencies(docs: DataFrame, text_col: str, words: set[bytes]) -> tuple[int, dict[bytes, int]]:
    """Number of documents, and how many of them hold each of ``words`` (a licence vocabulary: what reaches the
    driver is bounded by it)."""
    def count(batches):
        n, held = 0, Counter()
        for _, texts in _texts(batches, "text"):
            n += len(texts)
            for text in texts:
                held.update(words.intersection(file_words(text)))
        yield pa.RecordBatch.from_pydict({"word": pa.array([None, *held], pa.binary()), "n": pa.array([n, *held.values()], pa.int64())})

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    return found.pop(None, 0), found


def rare_word_index(kinds: list[Template], n_docs: int, held: dict[bytes, int]) -> dict[bytes, list[tuple[int, tuple[int, ...], tuple[bytes, ...]]]]:
    """Rarest key word -> (template, positions of its two rarest key words, those words)."""
    idf = lambda w: math.log((n_docs + 1) / (held.get(w, 0) + 1))
    index: dict = {}
    for t, kind in enumerate(kinds):
        ranked = sorted(kind.keys, key=lambda x: (-idf(x[0]), x))
        first = ranked[0]
        pair = [first, *[x for x in ranked if x[0] != first[0]][:1]]
        index.setdefault(first[0], []).append((t, tuple(p for _, p in pair), tuple(w for w, _ in pair)))
    return index


def _near(places: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each wanted position whether a place is within ``SLACK`` of it; places ascend."""
    at = np.searchsorted(places, wanted - SLACK)
    return (at < len(places)) & (places[np.minimum(at, len(places) - 1)] <= wanted + SLACK)


def _phrase_places(places: dict[bytes, np.ndarray], phrase: tuple[bytes, ...]) -> np.ndarray:
    """Where the words of a phrase stand one after another."""
    found = places[phrase[0]]
    for k, w in enumerate(phrase[1:], 1):
        found = found[np.isin(found + k, places[w], assume_unique=True)]
    return found


def best_cover(kind: Template, places: dict[bytes, np.ndarray], starts: np.ndarray) -> tuple[float, int] | None:
    """Best share of a notice's words found near their places over the possible ``starts`` whose key phrases
    verify, and the first start that reaches it; None where it is below ``MIN_COVER``."""
    for at, phrase in kind.phrases:
        found = _phrase_places(places, phrase)
        if not len(found):
            return None
        starts = starts[_near(found, starts + at)]
        if not len(starts):
            return None
    cover = np.zeros(len(starts), dtype=np.int64)
    for k, w in enumerate(kind.words):
        if w in places:
            cover += _near(places[w], starts + k)
    best = int(cover.max())
    if best < MIN_COVER * len(kind.words):
        return None
    return best / len(kind.words), int(starts[np.argmax(cover)])


def notices(words: list[bytes], kinds: list[Template], index: dict, vocabulary: set[bytes]) -> list[tuple[str, float, int]]:
    """(label, cover, start) for every template found in a file, by the index."""
    if index.keys().isdisjoint(words):
        return []
    lists: dict[bytes, list[int]] = {}
    for i, w in enumerate(words):
        if w in vocabulary:
            lists.setdefault(w, []).append(i)
    places = {w: np.array(x) for w, x in lists.items()}
    spread, out = np.arange(-SLACK, SLACK + 1), []
    for rare in index.keys() & places.keys():
        for t, positions, pair in index[rare]:
            kind = kinds[t]
            if any(w not in places for w, _ in kind.keys):
                continue
            starts = np.unique((places[rare] - positions[0])[:, None] + spread[None, :])
            for p, w in zip(positions[1:], pair[1:]):
                starts = starts[_near(places[w], starts + p)]
            if len(starts) and (found := best_cover(kind, places, starts)):
                out.append((kind.label, *found))
    return sorted(out)


def base_places(words: list[bytes], phrases: list[tuple[tuple[bytes, ...], str]]) -> list[tuple[int, str]]:
    """(start, label) wherever a base phrase stands; the phrases share their last word."""
    last = phrases[0][0][-1]
    out = []
    for i in (i for i, w in enumerate(words) if w == last):
        for phrase, label in phrases:
            start = i + 1 - len(phrase)
            if start >= 0 and tuple(words[start:i + 1]) == phrase:
                out.append((start, label))
    return out


_RESULT = ("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
           "notices array<struct<label:string,cover:double,start:long>>")


def _scan(kinds: list[Template], index: dict, id_type: pa.DataType) -> Callable:
    vocabulary = {w for kind in kinds for w in kind.words}
    phrases = [(tuple(file_words(p.encode())), label) for p, label in BASE]
    fields = [("id", id_type), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
              ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
              ("notices", pa.list_(pa.struct([("label", pa.string()), ("cover", pa.float64()), ("start", pa.int64())])))]

    def scan(batches):
        for batch, texts in _texts(batches, "text"):
            out: dict = {name: [] for name, _ in fields[1:]}
            for text in texts:
                words = file_words(text)
                base, found = base_places(words, phrases), notices(words, kinds, index, vocabulary)
                own = {label for _, label in base}
                starts = [start for start, _ in base]
                row = (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(own)),
                       ",".join(sorted(own | {label for label, _, _ in found})), 1.0 if base else max((c for _, c, _ in found), default=0.0),
                       [{"label": label, "cover": cover, "start": start} for label, cover, start in found])
                for name, value in zip(out, row):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(id_type), *[pa.array(out[n], t) for n, t in fields[1:]]], names=[n for n, _ in fields])
    return scan


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", entries=TEMPLATES) -> DataFrame:
    """One row per row of ``docs``: id, n_words, n_base, first_word, last_word (base places), base_labels, labels, score
    (1 with a base phrase, else the best cover of a notice, else 0) and the notices found."""
    kinds = templates(entries)
    n, held = document_frequencies(docs, text_col, {w for kind in kinds for w, _ in kind.keys})
    index = rare_word_index(kinds, n, held)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    return rows.mapInArrow(_scan(kinds, index, to_arrow_type(kind)), f"id {kind.simpleString()}, {_RESULT}")


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return license_scan(docs).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
