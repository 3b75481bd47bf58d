"""Licence scan: against a check of every position in plain Python, edited notices, awkward rows."""

import random
import re

import pytest

from funnelspark.llm import license_scan as S
from plain import LOWER

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
KINDS = [(label, WORD.findall(notice.translate(LOWER)), [WORD.findall(p) for p in phrases]) for label, notice, phrases in S.TEMPLATES]


def plain(text):
    """n_words, n_base, first_word, last_word, base_labels, labels, score; every notice at every position."""
    words = WORD.findall((text or "").translate(LOWER))
    base = [(i, label) for phrase, label in S.BASE for i in range(len(words)) if words[i:i + len(phrase.split())] == phrase.split()]
    at = lambda w, i: any(0 <= k < len(words) and words[k] == w for k in range(i - S.SLACK, i + S.SLACK + 1))
    stands = lambda p, i: any(k >= 0 and words[k:k + len(p)] == p for k in range(i - S.SLACK, i + S.SLACK + 1))
    labels, score = {label for _, label in base}, 1.0 if base else 0.0
    for label, notice, phrases in KINDS:
        for start in range(-len(notice), len(words) + 1):
            first = [next(i for i in range(len(notice)) if notice[i:i + len(p)] == p) for p in phrases]
            if all(stands(p, start + f) for p, f in zip(phrases, first)):
                cover = sum(at(w, start + k) for k, w in enumerate(notice)) / len(notice)
                if cover >= S.MIN_COVER:
                    labels.add(label)
                    score = max(score, cover)
    starts = [i for i, _ in base]
    return (len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
            ",".join(sorted(labels)), score)


def edited(rng, words):
    words = list(words)
    for _ in range(rng.randrange(4)):
        at, kind = rng.randrange(len(words)), rng.randrange(3)
        words[at:at + 1] = [] if kind == 0 else ["other"] if kind == 1 else [words[at], "more"]
        words = words or ["x"]
    return words


def texts():
    rng = random.Random(3)
    out = [None, "", " \n", "MIT License", "the MIT  LICENSE mit-license, Mit\nlicense", "Apache license MIT licence general public LICENSE",
           "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "Licensed under the Apache License, Version 2.0.",
           "license " * 3000 + "released under the mit license" + " mit" * 2000, "été ÉTÉ MIT license é", "mİt license", "a" * 100_000, "4 0 by cc",
           "nc nc nc by cc by nc 4 0 licensed"]
    for _, notice, _ in S.TEMPLATES:
        out += [notice, "before " + notice.upper() + " after"]
        for _ in range(4):
            filler = [rng.choice(["the", "license", "version", "2", "0", "gnu", "public", "mit", "word"]) for _ in range(rng.randrange(20))]
            out.append(" ".join(filler + edited(rng, WORD.findall(notice.translate(LOWER))) + filler))
    return out


def outcome(r):
    return tuple(r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels")) + (pytest.approx(r["score"]),)


def test_every_position_in_plain_python(make_docs):
    rows = [(k, t) for k, t in enumerate(texts())] + [(None, "MIT license"), (1, "Released under the MIT License")]
    got = S.license_scan(make_docs(rows).repartition(3)).collect()
    assert sorted(((r["id"], *outcome(r)[:6]) for r in got), key=repr) == sorted(((k, *plain(t)[:6]) for k, t in rows), key=repr)
    scores = {r["id"]: r["score"] for r in got if r["id"] not in (None, 1)}
    assert all(plain(t)[6] == pytest.approx(scores[k]) for k, t in rows if k in scores)
    assert sum(bool(r["labels"]) for r in got) > 80


def test_documents_have_their_licence_lines(spark, sf_dir):
    got = {r["doc_id"]: r for r in S.op13_license_scan(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        assert outcome(got[r["doc_id"]])[:6] == plain(r["text"])[:6]


def test_empty_table_and_unfit_templates(make_docs):
    assert S.license_scan(make_docs([])).collect() == []
    with pytest.raises(ValueError):
        S.template("x", "some notice", ("missing words",))


def test_rarest_words_lead_the_index():
    kinds = S.templates([("a", "one two three", ("two three",)), ("b", "three four", ("three four",))])
    index = S.rare_word_index(kinds, 100, {b"two": 90, b"three": 5, b"four": 5})
    assert index == {b"three": [(0, (2, 1), (b"three", b"two"))], b"four": [(1, (1, 0), (b"four", b"three"))]}
