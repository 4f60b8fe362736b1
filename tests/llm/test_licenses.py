import random

from tracklathe.llm import licenses as lic

FILLER = "\n".join(f"plain line {i} about nothing in particular" for i in range(300))


def test_each_wording_is_found(make):
    rows = [(k, f"{FILLER}\n{text}\n{FILLER}", "en", "a", 0) for k, (_, text) in enumerate(lic.TEMPLATES)]
    out = {r["doc_id"]: r for r in lic.scan(make(rows)).where("confirmed").collect()}
    assert {k: out[k]["license"] for k in out} == {k: name for k, (name, _) in enumerate(lic.TEMPLATES)}
    assert all(r["block_start"] == len(FILLER) + 1 for r in out.values())


def test_wording_decides(make):
    rows = [
        (1, "This work is licensed under the GNU General Public License, version 9.", "en", "a", 0),
        (2, "This work is NOT licensed under the GNU General Public License, version 3.", "en", "a", 0),
        (3, "this work is licensed  under the gnu general public license version 3", "en", "a", 0),
        (4, "Our licensing department has moved to the second floor.", "en", "a", 0),
    ]
    out = {r["doc_id"]: r for r in lic.scan(make(rows)).collect()}
    assert not out[1]["confirmed"] and "9" in out[1]["added"]
    assert not out[2]["confirmed"] and out[3]["confirmed"] and out[3]["license"] == "GPL-3.0"
    assert 4 not in out or not out[4]["confirmed"]


def test_template_order_breaks_ties_and_saves():
    rows = lic.examine("Licensed under CC BY-NC 4.0.", (("a", "Licensed under CC BY-NC 4.0."), ("b", "Licensed under CC BY-NC 4.0.")))
    assert rows[0][0] == "a" and rows[0][2] > 0.3 and rows[0][6]


def test_all_found_in_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wordings = [t for _, t in lic.TEMPLATES]
    wanted = sum(line in wordings for r in docs.collect() for line in r["text"].split("\n"))
    assert lic.scan(docs).where("confirmed").count() >= wanted > 0


def test_long_lines(make):
    text = "word " * 5000 + "Released under the MIT License. " + "word " * 5000
    rows = lic.scan(make([(1, text, "en", "a", 0)])).where("confirmed").collect()
    assert rows and {r["license"] for r in rows} == {"MIT"}


def test_short_notices_in_prose():
    rng = random.Random(0)
    templates = tuple(t for t in lic.TEMPLATES if len(t[1]) < 300)
    for n in (40, 200, 2000):
        for name, notice in templates:
            own = ["".join(rng.choice("ba ke li mo nu ra se ti vo wen dor".split()) for _ in range(rng.randint(1, 4))) for _ in range(n)]
            text = " ".join([*own[: n // 3], notice, *own[n // 3 :]])
            assert (text.index(notice), name) in [(r[0], r[1]) for r in lic.found(text, templates) if r[-1]]


def test_every_notice_gives_a_row():
    templates = tuple(lic.TEMPLATES)
    rows = lambda t: [(r[0], r[1]) for r in lic.found(t, templates) if r[-1]]
    both = "Licensed under the MIT License. Licensed under CC BY 4.0."
    assert rows(both) == [(0, "MIT"), (32, "CC-BY-4.0")]
    wrapped = lic.APACHE.replace(" you", "\n# you")
    assert rows(wrapped + "\nReleased under the MIT License.") == [(0, "Apache-2.0"), (len(wrapped) + 1, "MIT")]


def confirmed(text, templates=tuple(lic.TEMPLATES)):
    return [r[1] for r in lic.found(text, tuple(templates)) if r[-1]]


def test_bsd_texts_are_told_apart():
    two = lic.BSD_OPENING + lic.BSD_END
    three = lic.BSD_OPENING + lic.BSD_THIRD + lic.BSD_END
    assert confirmed("Copyright 2020 Someone\n\n" + two) == ["BSD-2-Clause"]
    assert confirmed(three.replace("provided that", "provided\n# that").replace(". ", ".\n\n")) == ["BSD-3-Clause"]
    assert confirmed(lic.BSD_OPENING) == ["BSD-2-Clause or BSD-3-Clause"]


def test_identifiers_and_full_texts():
    assert confirmed("/* SPDX-License-Identifier: MIT */") == ["MIT"]
    assert confirmed("# SPDX-License-Identifier: GPL-2.0-or-later\ncode") == ["GPL-2.0-or-later"]
    assert confirmed(lic.MIT.replace("Software", "Software\n *")) == ["MIT"]
    assert confirmed(lic.ISC) == ["ISC"] and confirmed(lic.UNLICENSE) == ["Unlicense"]


def test_custom_templates_need_no_known_words(make):
    own = [("Own", "You can do what you want with this work, as long as you tell nobody."), ("None", " ... ")]
    text = f"{FILLER}\n{own[0][1]}\n{FILLER}"
    rows = lic.scan(make([(1, text, "en", "a", 0)]), own).collect()
    assert [(r["license"], r["confirmed"]) for r in rows] == [("Own", True)]


def test_equals_every_window(monkeypatch):
    """Windows at every place, for every template, find no wording that those at cues don't."""
    rng = random.Random(1)
    templates = tuple(t for t in lic.TEMPLATES if len(t[1]) < 400)
    some = sorted({w for _, t in templates for w in t.split()})
    every = lambda own, texts, marks: ((k, lo) for k, t in enumerate(texts) if t for lo in range(-len(t) + 1, len(own)) if not {*t}.isdisjoint(own[max(lo, 0) : lo + len(t)]))
    for _ in range(15):
        parts = []
        for _, notice in rng.sample(templates, 2):
            own = notice.split()
            for _ in range(rng.randint(0, 2)):
                at = rng.randrange(len(own))
                own[at : at + rng.randint(0, 1)] = rng.choice([[], ["really"], [rng.choice(some)]])
            parts += [rng.choice(FILLER.split()) for _ in range(300)] + own
        text = " ".join(parts)
        at_cues = [(r[0], r[1]) for r in lic.found(text, templates) if r[-1]]
        with monkeypatch.context() as m:
            m.setattr(lic, "windows", every)
            assert [(a, r[0]) for a, r in lic.placed(text, templates) if r[-1]] == at_cues


def test_odd_rows(odd, none, make):
    assert lic.scan(odd).count() == 0 and lic.scan(none).count() == 0
    twice = make([(None, "Released under the MIT License.", None, None, None)] * 2)
    assert lic.scan(twice).count() == 2
    assert lic.scan(twice, []).count() == 0
