"""License scans against a brute-force comparison of every aligned window."""

import random
import textwrap
from collections import Counter

from pyspark.sql import functions as F

from textloom.llm import license_scan as ls
from textloom.llm.license_texts import BSD_NAMES, MIT_GRANT, TEMPLATES, _gnu

DOCS = "doc_id bigint, text string"


def found(spark, rows):
    df = spark.createDataFrame(rows, DOCS)
    return Counter((r.doc_id, tuple(r.licenses), r.n_license_words) for r in ls.license_summary(df).collect())


def licenses(spark, rows):
    return {k: names for k, names, _ in found(spark, rows)}


def test_licences_as_they_are_written(spark):
    mit = dict(enumerate(t for n, t in TEMPLATES if n == "MIT"))[0]
    opening = "MIT License\n\nCopyright (c) 2020 A Person\n\n" + textwrap.fill(MIT_GRANT, 76)
    noise = " ".join(f"word{k}" for k in range(300))
    rows = [
        (1, opening),
        (2, f"{noise}\n" + " " * 400 + "Released under  the\tMIT License."),
        (3, "\n".join("# " + x for x in textwrap.wrap(mit.replace("Software", "Program"), 40))),
        (4, f"{noise} and so, Licensed under the Apache License, Version 2.0, it is {noise}"),
        (5, textwrap.fill(_gnu("General Public License", "3"), 60)),
        (6, noise),
        (7, "© all RIGHTS reserved!"),
        (8, BSD_NAMES),
        (9, "This work is licensed under the GNU General Public License, version 2."),
        (10, "Licensed under CC BY-NC 4.0.\nx\nLicensed under CC BY 4.0."),
        (11, "long " * 300_000 + "Licensed under CC BY 4.0."),
    ]
    assert licenses(spark, rows) == {
        1: ("MIT",), 2: ("MIT",), 3: ("MIT",), 4: ("Apache-2.0",), 5: ("GPL-3.0",), 6: (), 7: ("Proprietary",), 8: (), 9: ("GPL-2.0",), 10: ("CC-BY-4.0", "CC-BY-NC-4.0"), 11: ("CC-BY-4.0",),
    }


def test_nulls_repeats_ties_and_clashes(spark):
    twice = "licensed under the apache license version 2.0"
    rows = [(1, None), (2, ""), (3, twice), (3, twice), (None, twice), (4, "MIT"), (3, "other text here")]
    assert found(spark, rows) == Counter({(1, (), 0): 1, (2, (), 0): 1, (3, ("Apache-2.0",), 8): 2, (None, ("Apache-2.0",), 8): 1, (4, (), 0): 1, (3, (), 0): 1})
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("w", "id", "license", "code", "best_dice")})
    assert ls.license_summary(df).count() == len(rows) and ls.license_summary(df.limit(0)).count() == 0


def test_spans_against_brute_force(spark):
    """Every window of a template's length in which the template and the text have an anchor at the same place."""
    rnd = random.Random(7)
    pieces = [ls.template_words(t) for _, t in TEMPLATES]
    rows = []
    for k in range(25):
        words = []
        for _ in range(rnd.randrange(1, 5)):
            piece = list(rnd.choice(pieces))
            for _ in range(rnd.randrange(0, 1 + len(piece) // 6)):
                at = rnd.randrange(len(piece))
                piece[at : at + rnd.randrange(2)] = [rnd.choice("abc") for _ in range(rnd.randrange(2))]
            words += piece + [rnd.choice("abc")] * rnd.randrange(3)
        rows.append((k, " ".join(words)))
    places = [ls.anchors(body, ls.LEAST_DICE) for body in pieces]
    expected = set()
    for k, text in rows:
        w = ls.template_words(text)
        for t, body in enumerate(pieces):
            own = set(zip(body, body[1:]))
            for begin in {i - j for i, a in enumerate(zip(w, w[1:])) for j in places[t] if a == (body[j], body[j + 1])}:
                window = w[max(0, begin) : begin + len(body)]
                other = set(zip(window, window[1:]))
                if (dice := 2 * len(own & other) / (len(own) + len(other))) >= ls.LEAST_DICE:
                    expected.add((k, t, max(0, begin), min(begin + len(body), len(w)), round(dice, 9)))
    spans = ls.license_spans(spark.createDataFrame(rows, DOCS)).collect()
    got = {(r.id, r.template, r.start, r.stop, round(r.dice, 9)) for r in spans}
    assert got == expected and len(expected) > 50


def test_anchors_are_enough_for_any_set_that_reaches_the_threshold():
    rnd = random.Random(3)
    for _, text in TEMPLATES:
        words = ls.template_words(text)
        own = sorted(set(zip(words, words[1:])))
        chosen = {(words[k], words[k + 1]) for k in ls.anchors(words, ls.LEAST_DICE)}
        need = ls.least_bigrams(len(own), ls.LEAST_DICE)
        assert 2 * (need - 1) / (len(own) + need - 1) < ls.LEAST_DICE
        assert all(chosen & set(rnd.sample(own, need)) for _ in range(50))


def test_a_reserved_notice_counts_only_by_itself(spark):
    from textloom.llm.license_texts import BSD_AS_IS, BSD_SOURCE

    bsd = f"Copyright (c) 2019, A Person\nAll rights reserved.\n\n{BSD_SOURCE}\n{BSD_AS_IS}"
    got = licenses(
        spark,
        [
            (1, bsd),
            (2, "Copyright 2020 A. All rights reserved.\n\nLicensed under the Apache License, Version 2.0."),
            (3, "Then the King decided that all rights reserved for nobles were void"),
            (4, "Some text.\n\n  All rights reserved.\nMore text."),
            (5, "(c) 2001 Example, Inc. All Rights Reserved"),
            (6, "© 2001 Example\nall rights reserved to nobody"),
        ],
    )
    assert got == {1: ("BSD-2-Clause",), 2: ("Apache-2.0",), 3: (), 4: ("Proprietary",), 5: ("Proprietary",), 6: ()}
