import random

import pytest

from ledgerloom.llm import licenses


def test_every_notice_is_found(spark):
    rows = [(i, f"words before.\n{t} Then more words follow.") for i, t in enumerate(licenses.TEMPLATES.values())]
    got = {r["doc_id"]: r["matches"] for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, name in enumerate(licenses.TEMPLATES):
        match = next(m for m in got[i] if m["template"] == name)
        assert match["coverage"] == 1.0 and match["start"] == 14
        shown = rows[i][1][match["start"] : match["end"]]
        assert licenses._WORD.findall(shown.lower()) == licenses._WORD.findall(licenses.TEMPLATES[name].lower())


def test_edited_copies_and_spans():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    text = licenses.TEMPLATES["MIT"].replace("free of charge", "free of any charge").replace("modify, ", "")
    (match,) = index.scan(text, 0.8)
    assert match["template"] == "MIT" and 0.9 < match["coverage"] < 1 and len(match["spans"]) >= 2
    assert index.scan("Permission is hereby granted, free of charge, to any person", 0.8) == []
    twice = index.scan("Released under the MIT License. x y z. Released under the MIT License.", 0.8)
    assert [m["start"] for m in twice] == [0, 39]


def test_alignment_is_a_longest_common_subsequence():
    index = licenses.TemplateIndex({"t": "a b c d e f g h"})
    ids = licenses.np.array([index.vocabulary.get(w, 0) for w in "x a b q c d f g h y".split()])
    pairs = index.align(0, ids, 1)
    assert [index.ids[0][i] for i, _ in pairs] == [ids[j] for _, j in pairs] and len(pairs) == 7


def test_odd_rows(odd_docs, no_docs):
    got = licenses.scan_licenses(odd_docs).collect()
    assert len(got) == 10 and all(r["n_matches"] == 0 for r in got) and licenses.scan_licenses(no_docs).count() == 0
    with pytest.raises(ValueError):
        licenses.TemplateIndex({"short": "a b"})


def test_offsets_where_lower_case_is_longer():
    text = "İ İ. Released under the MIT License"
    (match,) = licenses.TemplateIndex(licenses.TEMPLATES).scan(text, 0.8)
    assert text[match["start"] : match["end"]] == "Released under the MIT License"


def test_recall_against_alignment_everywhere():
    """Of the texts whose alignment at some diagonal covers 0.8, the index
    proposes nine in ten or more for every template, and what it finds covers as
    much as the best alignment does."""
    index, rng = licenses.TemplateIndex(licenses.TEMPLATES), random.Random(6)
    texts = [
        "This work is licensed under the terms of the GNU General Public License, version 3",
        "Licensed under Apache License, Version 2.0",
    ]
    for template in licenses.TEMPLATES.values():
        for every in (3, 4, 5, 6, 7, 9, 12):
            for _ in range(3):
                words = licenses._WORD.findall(template)
                for at in range(rng.randrange(every), len(words), every):
                    words[at] = rng.choice(["", "other", f"{words[at]} more"])
                texts.append(f"some words before {' '.join(words)} and after the text")
    known, met = {n: 0 for n in index.names}, {n: 0 for n in index.names}
    for text in texts:
        ids = licenses.np.array([index.vocabulary.get(w, 0) for w in licenses._WORD.findall(text.lower())], licenses.np.int64)
        got = {m["template"]: m["coverage"] for m in index.scan(text, 0.8)}
        for t, name in enumerate(index.names):
            own = len(index.ids[t])
            best = index._tables(t, ids, licenses.np.arange(-own, len(ids) + 1))[0, :, 0].max() / own
            known[name] += best >= 0.8
            met[name] += name in got
            assert name not in got or got[name] == round(best, 6), (name, text)
    assert min(known.values()) >= 8 and all(met[n] >= 0.9 * known[n] for n in known), {n: (met[n], known[n]) for n in known}
    print({n: (met[n], known[n]) for n in known})
    assert {m["template"] for x in texts[:2] for m in index.scan(x, 0.8)} == {"GPL-notice", "Apache-2.0-notice"}


def test_the_index_alone_proposes(monkeypatch):
    monkeypatch.setattr(licenses.TemplateIndex, "places", lambda self, ids: [])
    assert licenses.TemplateIndex(licenses.TEMPLATES).scan(licenses.TEMPLATES["MIT"], 0.8) == []


def plain_lcs(own, ids, diagonal, band):
    """Longest common subsequence of the cells within the band, cell by cell."""
    best = {}
    for i in range(len(own) - 1, -1, -1):
        for j in range(diagonal + i + band, diagonal + i - band - 1, -1):
            inside = 0 <= j < len(ids)
            step = best.get((i + 1, j + 1), 0) + 1 if inside and ids[j] == own[i] else 0
            best[i, j] = max(step, best.get((i + 1, j), 0) if j >= diagonal + i + 1 - band else 0, best.get((i, j + 1), 0) if j < diagonal + i + band else 0)
    return best[0, diagonal - band]


def test_alignment_tables_against_plain_ones():
    """Short notices at all diagonals, whole licences around the right one."""
    index, rng = licenses.TemplateIndex(licenses.TEMPLATES), random.Random(2)
    for t, own in enumerate(index.ids):
        ids = [rng.choice([0, *own]) for _ in range(10)] + [w for w in own if rng.random() < 0.8] + [0] * rng.randint(0, 5)
        ids = licenses.np.array(ids)
        diagonals = licenses.np.arange(-5, len(ids)) if len(own) <= 60 else licenses.np.array([-40, -8, 0, 7, 10, 90])
        got = index._tables(t, ids, diagonals)[0, :, 0]
        assert got.tolist() == [plain_lcs(own.tolist(), ids.tolist(), d, index.band_of(t)) for d in diagonals.tolist()]


def test_whole_licences_are_told_apart():
    index = licenses.TemplateIndex(licenses.TEMPLATES)
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC", "Zlib"):
        found = {m["template"]: m["coverage"] for m in index.scan(f"Copyright someone\n\n{licenses.TEMPLATES[name]}\n", 0.8)}
        assert found[name] == 1.0 and all(c < 1 for n, c in found.items() if n != name and not n.endswith("notice")), found


def test_many_copies_in_one_text():
    notice = licenses.TEMPLATES["MIT-notice"]
    text = " and then ".join([notice] * 3000)
    assert len(licenses.TemplateIndex(licenses.TEMPLATES).scan(text, 0.8)) == 3000
