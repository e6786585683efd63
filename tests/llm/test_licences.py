"""Licence scans against a cosine of every run of every template's length, and inheritance on a small tree."""

import collections
import math
import random
import re

import pytest

from quirespark.llm import licences


def brute(text, n_files, frequencies, least=0.8):
    """The best (licence, score) over all runs, each compared by itself."""
    n_files = max(1, n_files)
    weigh = lambda w: math.log((1 + n_files) / (1 + frequencies.get(w, 1))) + 1
    words = re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", text.lower())
    best = (0.0, None)
    for name, template in licences.TEMPLATES:
        asked = collections.Counter(re.findall(r"[^\W_]+(?:[.\-][^\W_]+)*", template.lower()))
        size = sum(asked.values())
        for start in range(max(1, len(words) - size + 1)):
            own = collections.Counter(words[start : start + size])
            dot = sum(own[w] * asked[w] * weigh(w) ** 2 for w in own)
            norms = [math.sqrt(sum((c * weigh(w)) ** 2 for w, c in x.items())) for x in (own, asked)]
            cosine = dot / (norms[0] * norms[1]) if own else 0.0
            if cosine >= least and (-round(cosine, 6), name) < (-best[0], best[1] or "~"):
                best = (round(cosine, 6), name)
    return (best[1], best[0])


def test_matcher():
    """Whole notices, notices with words left out or turned round, between other words, whatever the frequencies."""
    r = random.Random(1)
    found = 0
    for _ in range(150):
        n = r.choice([1, 5, 1000])
        frequencies = {w: r.randrange(0, n + 1) if r.random() < 0.5 else 0 for w in licences.vocabulary()}
        words = []
        for _ in range(r.randrange(1, 4)):
            words += [r.choice(["foo", "bar", "the", "of", "x9", "Software"]) for _ in range(r.randrange(0, 12))]
            notice = re.findall(r"\S+", r.choice(licences.TEMPLATES)[1])
            notice = [w for w in notice if r.random() < r.choice([0.7, 0.9, 1])]
            if r.random() < 0.3:
                r.shuffle(notice)
            words += notice
        text = "".join(w + r.choice([" ", "\n", " \n "]) for w in words)
        expected = brute(text, n, frequencies)
        assert licences.Matcher(n, frequencies).scan(text) == expected
        found += expected[0] is not None
    assert 50 < found


@pytest.mark.parametrize("wrap", [1, 5, 8, 10**6])
def test_wrapped(wrap):
    """A notice is found wherever its lines end, inside a line of any length, and in a run of thousands of words."""
    matcher = licences.Matcher(10**6, {w: 1000 for w in licences.vocabulary()})
    for name, template in licences.TEMPLATES:
        words = ("some other words before it " * 700).split() + template.split() + ("and after it none " * 700).split()
        text = "\n".join(" ".join(words[i : i + wrap]) for i in range(0, len(words), wrap))
        assert matcher.scan(text) == (name, 1.0)
    assert matcher.scan("\n".join(["Released under the MIT License."] * 200).replace("\n", " ")) == ("MIT", 1.0)
    head = "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n\n   1. Definitions.\n"
    assert matcher.scan(head)[0] == "Apache-2.0"


def test_licences(spark):
    body = "Some words of a file that no licence has. " * 30
    rows = [
        (1, "r/LICENSE", "Released under the MIT License."),
        (2, "r/a/b/x.txt", body),
        (3, "r/a/LICENSE.txt", "Licensed under the Apache License, Version 2.0.\n" + body),
        (4, "r/c/y.txt", body + "\nThis work is licensed under the GNU General Public License, version 3.\n" + body),
        (5, "r/c/z.txt", None),
        (6, "other/q.txt", ""),
        (7, None, body),
        (7, None, body),
        (8, "r/c/w.txt", "the version of the work that this is"),
        (9, "top.txt", "All rights reserved."),
    ]
    table = spark.createDataFrame([(*r, "n") for r in rows], "doc_id long, path string, text string, license string")
    found = licences.licence_scan(table, keep=("doc_id",)).collect()
    assert len(found) == len(rows)
    got = {r.doc_id: (r.own_license, r.license, r.license_from, r.levels) for r in found}
    assert got == {
        1: ("MIT", "MIT", None, None),
        2: (None, "Apache-2.0", "r/a", 1),
        3: ("Apache-2.0", "Apache-2.0", None, None),
        4: ("GPL-3.0-only", "GPL-3.0-only", None, None),
        5: (None, "MIT", "r", 1),
        6: (None, None, None, None),
        7: (None, None, None, None),
        8: (None, "MIT", "r", 1),
        9: ("LicenseRef-all-rights-reserved", "LicenseRef-all-rights-reserved", None, None),
    }




def test_names_and_ties(spark):
    """Kept columns that clash give way; of two licence files the better score, then the smaller path; repeated rows each get a row."""
    rows = [
        ("d/LICENSE", "Released under the MIT License."),
        ("d/COPYING", "All rights reserved."),
        ("d/x", "no licence here"),
        ("d/x", "no licence here"),
        ("e/NOTICE", ""),
        ("e/y", "z"),
    ]
    table = spark.createDataFrame([(*r, "mine", 7) for r in rows], "path string, text string, license string, own_score int")
    for keep in (("path",), ("license",), ("own_score", "text", "text"), ("Path", "levels")):
        found = licences.licence_scan(table, keep=keep if "levels" not in keep else keep[:1])
        assert found.columns == [c for c in ("text",) if c in keep] + ["path", "own_license", "own_score", "license", "license_from", "levels"]
        got = collections.Counter((r.path, r.license, r.license_from) for r in found.collect())
        assert got == collections.Counter({("d/LICENSE", "MIT", None): 1, ("d/COPYING", "LicenseRef-all-rights-reserved", None): 1, ("d/x", "LicenseRef-all-rights-reserved", "d"): 2, ("e/NOTICE", None, None): 1, ("e/y", None, None): 1})


def test_one_huge_directory(spark):
    rows = [("r/LICENSE", "Released under the MIT License.")] + [(f"r/a/{i}.txt", "words") for i in range(5000)]
    found = licences.licence_scan(spark.createDataFrame(rows, "path string, text string"))
    assert found.where("license = 'MIT' and (levels = 1 or levels is null)").count() == 5001
