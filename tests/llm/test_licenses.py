"""License scans against plain Python and regular expressions."""

import random
import re

import pytest

from quarry.llm import licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.01"
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""


def base(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def pattern(items):
    """A template as a regular expression over words that each end in a blank."""
    out = ""
    for kind, *rest in items:
        if kind == "word":
            out += re.escape(rest[0]) + " "
        elif kind == "optional":
            out += f"(?:{pattern(rest[0])})?"
        elif kind == "any":
            out += rf"(?:[^ ]+ ){{{rest[0]},{rest[1]}}}"
        else:
            out += "(?:" + "|".join("".join(re.escape(w) + " " for w in words) for words in rest[0]) + ")"
    return out


def test_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = licenses.scanned(docs).collect()
    assert len(got) == len(texts)
    every = [(label, re.compile("(?:(?<= )|^)" + pattern(licenses.parsed(t)))) for label, t in licenses.TEMPLATES]
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(texts[r.doc_id])
        flat = "".join(w + " " for w in WORD.findall(texts[r.doc_id].lower()))
        labels = {label for label, p in every if p.search(flat)} | set(filter(None, r.base_labels.split(",")))
        assert r.labels == ",".join(sorted(labels))
        assert (r.score > 0) == bool(labels) and 0 <= r.score <= 1
    assert {"gpl-3", "mit", "apache-2", "cc-by-nc"} <= {x for r in got for x in r.labels.split(",")}


def labelled(spark, texts):
    rows = [(k, t, "c", 0.5) for k, t in enumerate(texts)]
    return {r.doc_id: r for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string, labels string, score double")).collect()}


def test_mandatory_wording_is_exact(spark):
    holder = MIT.replace("shall be", "(including the next paragraph) shall be")
    texts = [MIT, MIT.lower().replace(" ", "\n * "), MIT.replace("sublicense, ", ""), holder, "x " * 400 + MIT + " y", MIT + " " + MIT, MIT.replace("this software and associated documentation files", "this work")]
    got = labelled(spark, texts)
    assert [got[k].labels for k in range(len(texts))] == ["mit", "mit", "", "mit", "mit", "mit", ""]
    assert [(m.label, m.start) for m in got[4].matches] == [("mit", 400)] and len(got[5].matches) == 2 and got[0].score > 0.99
    assert got[0].matches[0].stop == got[0].n_words


def test_edges(spark):
    texts = [None, "", " ,.", "under the MIT license", "UNDER THE mit\nlicense under the mit license", "under the mit licenses", "cc-by-nc", "cc by", "Licensed under CC BY 4.0", "Licensed under CC BY-NC 4.0.", "wunder the mit license é under", "apache license version 2.0", "éunder the mit license", "SPDX-License-Identifier: MIT"]
    got = labelled(spark, texts * 2)
    for k, t in enumerate(texts * 2):
        r = got[k]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base(t)
    assert [got[k].labels for k in (3, 4, 5, 6, 7, 8, 9, 11, 12, 13)] == ["mit", "mit", "", "cc-by-nc", "", "cc-by", "cc-by-nc", "apache-2", "", "mit"]
    assert got[0].score == got[1].score == 0 and got[4].n_base == 2
    assert licenses.scanned(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automata_against_regular_expressions():
    rng = random.Random(5)
    letters = "abcd"

    def template(depth=0):
        out = []
        for _ in range(rng.randrange(1, 4)):
            kind = rng.randrange(5 if depth < 2 else 3)
            if kind < 2:
                out.append(rng.choice(letters))
            elif kind == 2:
                out.append(f'<<var;name="v";original="x";match=".{{{rng.randrange(2)},{rng.randrange(1, 3)}}}">>')
            elif kind == 3:
                out.append(f"<<beginOptional;name=o>>{template(depth + 1)}<<endOptional>>")
            else:
                out.append('<<var;name="v";match="a b|c|d d">>')
        return " ".join(out)

    for _ in range(300):
        text = "a " + template() + " b"
        auto, want = licenses.Automaton((("x", text),)), re.compile(pattern(licenses.parsed(text)))
        for _ in range(20):
            words = ["a"] + [rng.choice(letters + "e") for _ in range(rng.randrange(1, 9))]
            got = auto.matches(words.__getitem__, 0, len(words)).get(0)
            ends = [k for k in range(len(words) + 1) if want.fullmatch("".join(w + " " for w in words[:k]))]
            assert got == max(ends, default=None), (text, words)


@pytest.mark.parametrize("bad", ["<<beginOptional>>a", "a<<endOptional>>", '<<var;name="x";match=".+">> a'])
def test_bad_templates(bad):
    with pytest.raises(ValueError):
        licenses.Automaton((("x", bad),))


def test_many_candidates_in_one_text(spark):
    text = "permission is hereby granted free of charge to any person " * 20_000
    got = labelled(spark, [text, text + MIT])
    assert got[0].labels == "" and got[1].labels == "mit" and got[0].n_words == 200_000
