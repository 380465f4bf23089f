import random

import duckdb

from pairshift.llm import license_scan as ls
from pairshift.llm.queries import QUERIES


def words(text):
    return [m.decode() for m in ls._WORD.findall(text.encode().lower())]


def brute_names(text, templates=ls.TEMPLATES, share=0.75):
    """Templates of which some stretch holds enough of the shingles; the stretch has no more shingles than the template."""
    w, out = words(text), set()
    for name, t in templates.items():
        tw = words(t)
        k = min(5, len(tw))
        want = {tuple(tw[i : i + k]) for i in range(len(tw) - k + 1)}
        have = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        m = len(tw) - k + 1
        if any(len(want & set(have[i : i + m])) >= share * len(want) for i in range(max(1, len(have)))):
            out.add(name)
    return out


def noise(r, n):
    return " ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 6))) for _ in range(n))


def test_planted_templates_with_edits():
    r = random.Random(1)
    scan = ls.Templates(ls.TEMPLATES, 0.75).scan
    for _ in range(40):
        text, expect = noise(r, r.randint(0, 60)), set()
        for name in r.sample(sorted(ls.TEMPLATES), 3):
            t = ls.TEMPLATES[name].split()
            if len(t) > 20:
                t[r.randrange(6, len(t) - 6)] = "changed"
            text += "\n" + r.choice([" ".join(t), " ".join(t).upper(), "  \n".join(t)]) + " é " + noise(r, r.randint(6, 40))
        found = {m[0] for m in scan(text)}
        assert brute_names(text) <= found
        for name, a, b, share in scan(text):
            assert share >= 0.75 and words(text[a:b])[0] in words(ls.TEMPLATES[name])


def test_clean_text_and_parts_of_a_template_do_not_match():
    r = random.Random(2)
    scan = ls.Templates(ls.TEMPLATES, 0.75).scan
    assert scan("") == [] and scan("license") == [] and scan(noise(r, 3000)) == []
    half = ls.TEMPLATES["Apache-2.0-header"].split()
    assert "Apache-2.0-header" not in {m[0] for m in scan(" ".join(half[:40]))}


def test_spans_are_code_points():
    scan = ls.Templates(ls.TEMPLATES, 0.75).scan
    text = "é😀 x. Released under the MIT License. ü Released under the MIT License"
    assert [(m[0], text[m[1] : m[2]]) for m in scan(text)] == [("MIT", "Released under the MIT License")] * 2


def test_bands_reach_the_stated_miss():
    t = ls.Templates(ls.TEMPLATES, 0.75)
    for (_, c), g in t.classes.items():
        for k in g["members"]:
            m = len(t.sets[k])
            least = min(1, 0.75 * m / (c + c // 4 + 0.25 * m))
            assert m <= c and g["size"] >= m and (1 - least) ** len(g["odd"]) <= 1e-6 * 1.01


def test_whole_table_and_odd_rows(spark):
    d = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES["op5_license_scan"](spark, d).collect()}
    rows = duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{d}/documents.parquet')").fetchall()
    assert len(got) == len(rows)
    for i, t in rows:
        assert set(filter(None, got[i]["licenses"].split(","))) == brute_names(t or "") if "icen" in (t or "") else got[i]["n_matches"] == 0
    assert sum(r["n_matches"] > 0 for r in got.values()) > 5
    odd = [(1, None), (None, "Released under the MIT License"), (2, ""), (2, ""), (3, "the mit license"), (4, "w " * 30_000 + ls.TEMPLATES["ISC"])]
    df = spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 AS licenses", "2 AS id", "3 AS spans")
    found = sorted((str(r["doc_id"]), r["licenses"], r["n_matches"]) for r in ls.license_scan(df).collect())
    assert found == [("1", "", 0), ("2", "", 0), ("2", "", 0), ("3", "", 0), ("4", "ISC", 1), ("None", "MIT", 1)]
    short = ls.license_scan(df, templates={"mit": "the MIT license"}).where("doc_id = 3").collect()[0]
    assert short["licenses"] == "mit" and short["max_containment"] == 1.0
    assert ls.license_scan(df.limit(0)).count() == 0


def test_versions_families_and_wordings_are_told_apart():
    scan = ls.Templates(ls.default_templates(), ls.CONTAINMENT, exclusive=True).scan
    work = "This work is licensed under the GNU {}."
    for text, name in [
            (work.format("Lesser General Public License, version 3"), "LGPL-3.0"), (work.format("Affero General Public License, version 3"), "AGPL-3.0"),
            (work.format("General Public License, version 2"), "GPL-2.0"), (work.format("General Public License, version 3"), "GPL-3.0"),
            (work.format("General Public License"), "GPL"), ("Released under MIT License", "MIT"), ("Distributed under the MIT License", "MIT"),
            ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0"), ("made available under the Eclipse Public License 2.0", "EPL-2.0"),
            ("It is published under a CC BY-SA 3.0 licence", "CC-BY-SA-3.0"), ("Licensed under the Apache License, Version 1.1", "Apache-1.1")]:
        assert [m[0] for m in scan("Some words. " + text + " Other words.")] == [name], text


def test_whole_texts_and_neighbours():
    r = random.Random(3)
    scan = ls.Templates(ls.default_templates(), ls.CONTAINMENT, exclusive=True).scan
    whole = {n: max((w.text for w in ws), key=len) for n, ws in ls.licenses().items() if max(len(w.text) for w in ws) > 600}
    assert {"AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "Unlicense", "CC0-1.0", "BSD-2-Clause", "BSD-3-Clause", "MIT", "ISC"} <= set(whole)
    for name, text in whole.items():
        t = text.split()
        for i in r.sample(range(len(t)), len(t) // 100):  # scattered edits
            t[i] += "x"
        assert {m[0] for m in scan(noise(r, 30) + " " + " ".join(t) + " " + noise(r, 30))} == {name}
    both = whole["MIT"] + "\n\n" + whole["Apache-2.0"] + "\n\n" + whole["BSD-3-Clause"]
    assert [m[0] for m in scan(both)] == ["MIT", "Apache-2.0", "BSD-3-Clause"]
