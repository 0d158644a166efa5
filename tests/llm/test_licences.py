import random

import numpy as np

from strandflow.llm import license_scan, queries
from strandflow.llm.license_templates import TEMPLATES

LINES = {
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-statement",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0-statement",
    "Released under the MIT License.": "MIT-statement",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0-statement",
}


def test_lines_of_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = queries.op9_license_scan(spark, sf).collect()
    want = sorted((i, name) for i, t in texts.items() for line, name in LINES.items() for _ in range(t.count(line)))
    assert sorted((r.doc_id, r.license) for r in out) == want
    assert all(texts[r.doc_id][r.begin : r.end] + "." in LINES for r in out)


def test_changed_and_partial_notices(spark):
    mit = TEMPLATES["MIT"]
    words = mit.split()
    changed = " ".join(w for i, w in enumerate(words) if i % 17)
    wrapped = "// " + "\n// ".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9))
    rows = [(1, f"é intro {mit} outro"), (2, changed), (3, wrapped), (4, " ".join(words[:60])), (5, " ".join(reversed(words))), (6, f"{mit}\n\n{TEMPLATES['BSD-3-Clause']} x {mit}")]
    out = license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.begin)):
        by.setdefault(r.doc_id, []).append(r)
    assert [(r.license, r.coverage) for r in by[1]] == [("MIT", 1.0)]
    assert rows[0][1][by[1][0].begin : by[1][0].end] == mit.rstrip(".")
    assert by[2][0].license == "MIT" and 0.9 < by[2][0].coverage < 0.97
    assert [(r.license, r.coverage) for r in by[3]] == [("MIT", 1.0)]
    assert 4 not in by and 5 not in by
    assert [r.license for r in by[6]] == ["MIT", "BSD-3-Clause", "MIT"]


def test_every_template_finds_itself():
    index = license_scan.index_of(tuple(sorted(TEMPLATES.items())))
    for t, numbers in enumerate(index.templates):
        hashes = license_scan.gram_hashes(numbers)
        at = license_scan.winnowed(hashes)
        found = index.scan(numbers, at, hashes[at])
        assert (index.names[t], 1.0) in [(index.names[f[0]], f[1]) for f in found]


def test_odd_rows(odd_docs, no_docs):
    assert license_scan.scan(odd_docs).count() == 0 and license_scan.scan(no_docs).count() == 0


def plain_alignment(template, text):
    """The best score of the whole template against any part of the text, by the full table."""
    best = np.zeros((len(template) + 1, len(text) + 1), int)
    best[:, 0] = license_scan.GAP * np.arange(len(template) + 1)
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            same = license_scan.MATCH if template[i - 1] == text[j - 1] else license_scan.MISMATCH
            best[i, j] = max(best[i - 1, j - 1] + same, best[i - 1, j] + license_scan.GAP, best[i, j - 1] + license_scan.GAP)
    return int(best[-1].max())


def test_alignment_equals_plain():
    rng = random.Random(4)
    for _ in range(40):
        template = [rng.randrange(12) for _ in range(rng.randrange(5, 40))]
        own = list(template)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [rng.randrange(12) for _ in range(rng.randrange(3))]
            own = own or [0]
        before = [rng.randrange(100, 120) for _ in range(rng.randrange(30))]
        text = before + own + [rng.randrange(100, 120) for _ in range(rng.randrange(30))]
        found = license_scan.align(np.array(template), np.array(text), len(before))
        want = plain_alignment(template, text)
        if want > 0:
            matched, first, last = found
            assert 0 <= first <= last < len(text) and 2 * matched - (len(template) - matched) - (last - first + 1 - matched) <= want
            # What the words reported score at best is what the full table has.
            assert plain_alignment(template, text[first : last + 1]) == want


def test_changed_notices_are_found(spark):
    """Recall against aligning every template everywhere: notices with words replaced, dropped and added."""
    rng = random.Random(6)
    rows, want = [], []
    for name, text in TEMPLATES.items():
        words = text.split()
        if len(words) <= license_scan.SHORT_WORDS:
            continue
        for share in (0.03, 0.08):
            own = [w if rng.random() > share else rng.choice(["", "other", w + " more"]) for w in words]
            rows.append((len(rows), "some words before " + " ".join(own) + " and after"))
            want.append(name)
    out = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, set()).add(r.license)
    assert sum(w in out.get(i, ()) for i, w in enumerate(want)) >= 0.9 * len(want)


def test_statements_need_all_their_words(spark):
    near = ["This work is licensed under the GNU General Public License, version 2.", "Licensed under CC BY-ND 4.0.", "Released under the BSD License."]
    assert license_scan.scan(spark.createDataFrame(list(enumerate(near)), "doc_id long, text string")).count() == 0


def test_many_notices_in_one_text(spark):
    text = " ".join(list(LINES) * 1000)
    assert license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).count() == 4_000


def test_notices_divided_by_other_words(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for name in ("MIT", "GPL-3.0-or-later", "GPL-2.0-or-later", "LGPL-2.1-or-later", "AGPL-3.0-or-later", "ISC", "Zlib"):
        words = TEMPLATES[name].split()
        for more in (20, 40, 200):
            for cut in (len(words) // 2, len(words) // 3):
                other = [f"w{rng.randrange(999)}" for _ in range(more)]
                want[len(rows)] = name
                rows.append((len(rows), "before it " + " ".join(words[:cut] + other + words[cut:]) + " behind it"))
    # Halves too far apart, in the wrong order, and one half alone, are no notice.
    half = TEMPLATES["MIT"].split()[:60], TEMPLATES["MIT"].split()[60:]
    far = [f"w{i}" for i in range(400)]
    for words in (half[0] + far + half[1][:30], half[1][:60] + far[:30] + half[0], half[0]):
        rows.append((len(rows), " ".join(words)))
    out = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        out.setdefault(r.doc_id, []).append((r.license, r.begin, r.end, r.coverage))
    for i, name in want.items():
        assert [x[0] for x in out[i]] == [name] and out[i][0][3] > 0.95, (name, rows[i][1][:80], out[i])
        assert rows[i][1][out[i][0][1] :].startswith(TEMPLATES[name].split()[0]) and len(rows[i][1]) - out[i][0][2] < 14
    assert not set(out) - set(want)
