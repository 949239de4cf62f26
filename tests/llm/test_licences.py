import math
import re
import textwrap
from collections import Counter
from itertools import pairwise

from siteaudit.llm import licences as li


def test_families_unknowns_and_edges(spark):
    rows = [
        (1, "Some words.\nLicensed under the Apache License, Version 2.0.\nMore."),
        (2, "Released under the MIT License."),
        (3, "This work is licensed under the GNU General Public License, version 3."),
        (4, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License."),
        (5, "He got a licence to fish from the city.\nThe warranty of the apache pottery ended."),
        (6, None),
        (7, ""),
        (8, "a word " * 100_000 + "\nReleased under the MIT License."),
        (2, "Released under the MIT License."),
        (9, "Notice: licensed under the Apache License, Version 2.0 (the License), all of it."),
        (10, "Permission was given by the king. Copyright is a right."),
        (None, "Licensed under CC BY 4.0."),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, family string")
    model = li.fit(spark, docs)
    got = sorted(((r["doc_id"] or 0), r["n_licences"], tuple(r["families"])) for r in li.scanned(docs, model).collect())
    assert got == sorted(
        [
            (1, 1, ("Apache-2.0",)),
            (2, 1, ("MIT",)),
            (2, 1, ("MIT",)),
            (3, 1, ("GPL-3.0",)),
            (4, 2, ("CC-BY-NC", "MIT")),
            (5, 0, ()),
            (6, 0, ()),
            (7, 0, ()),
            (8, 1, ("MIT",)),
            (9, 1, ("Apache-2.0",)),
            (10, 0, ()),
            (0, 1, ("CC-BY",)),
        ]
    )
    nothing = spark.createDataFrame([], "doc_id long, text string")
    assert li.scanned(nothing, li.fit(spark, nothing)).count() == 0


def test_every_template_is_its_family(spark):
    rows = [(i, t, f) for i, (f, t) in enumerate((f, t) for f, ts in li.TEMPLATES.items() for t in ts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    got = {r["doc_id"]: r["families"] for r in li.scanned(docs, li.fit(spark)).collect()}
    assert [(i, got[i]) for i, _, f in rows if got[i] != [f]] == []


MIT = next(t for t in li.TEMPLATES["MIT"] if t.startswith("Permission"))
BSD = next(t for t in li.TEMPLATES["BSD"] if t.startswith("Redistribution"))
GPL = next(t for t in li.TEMPLATES["GPL-3.0"] if t.startswith("This program"))


def wrapped(text, width):
    return "\n".join(textwrap.wrap(text, width))


def test_bare_and_wrapped_notices(spark):
    prose = "The boat left the harbour in the morning.\nNobody saw it again that year."
    want = [
        ("All rights reserved.", 1, ["All-Rights-Reserved"]),
        (f"{prose}\nAll rights reserved.\n{prose}", 1, ["All-Rights-Reserved"]),
        ("MIT License", 1, ["MIT"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007", 1, ["GPL-3.0"]),
        ("GNU GENERAL PUBLIC LICENSE\n   Version 2, June 1991", 1, ["GPL-2.0"]),
        ("All rights reserved.\nReleased under the MIT License.", 2, ["All-Rights-Reserved", "MIT"]),
        ("All rights reserved.\nAll rights reserved.", 2, ["All-Rights-Reserved"]),
        (f"{prose}\n{wrapped(GPL, 60)}\n{prose}", 1, ["GPL-3.0"]),
        (f"MIT License\n\n{wrapped(MIT, 50)}", 2, ["MIT"]),
    ]
    want += [(wrapped(t, n), 1, [f]) for t, f in ((MIT, "MIT"), (BSD, "BSD")) for n in (40, 60, 80)]
    want += [(f"{prose}\n{wrapped(t, 70)}\n{prose}", 1, [f]) for t, f in ((MIT, "MIT"), (BSD, "BSD"))]
    # held back from the training: words of licences in ordinary paragraphs
    held = [
        "The driver showed his licence and the officer let him go.\nAll the rights of the tenants were kept.",
        "The king gave permission to build.\nThe public was free to use the garden, and the general came too.",
        "A copyright notice was found on the back of the map.\nIts version was older than the library itself.",
        "The warranty covers the engine.\nThe software of the car is free of charge for two years.",
    ]
    want += [(t, 0, []) for t in held]
    docs = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_licences"], r["families"]) for r in li.scanned(docs, li.fit(spark, docs)).collect()}
    assert [(t, got[i]) for i, (t, n, f) in enumerate(want) if got[i] != (n, f)] == []


def test_every_place_of_a_line_is_looked_at(spark):
    """Several notices on one line, a notice amid other words of its line, and a cue over a line end."""
    prose = " ".join(["the boat left the harbour with the software of the general public and a version of it"] * 40)
    want = [
        ("Released under the MIT License. Licensed under CC BY 4.0.", ["CC-BY", "MIT"]),
        (f"{prose} {MIT} {prose} {BSD} {prose}", ["BSD", "MIT"]),
        (f"{prose} Licensed under the Apache License, Version 2.0. {prose}", ["Apache-2.0"]),
        (f"{prose} {wrapped(GPL, 60)} {prose}", ["GPL-3.0"]),
        ("The map is ours.\n\nAll\nrights\nreserved.", ["All-Rights-Reserved"]),
        (prose, []),
        (f"{prose} she asked for permission, and the licence was free of charge {prose}", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in li.scanned(docs, li.fit(spark, docs)).collect()}
    assert [(t[:60], got[i], f) for i, (t, f) in enumerate(want) if got[i] != f] == []


def test_plans_stay_small_and_cover_is_the_largest_share(spark):
    """No plan holds the templates (before, one held them several times: 280,000 characters)."""
    texts = [t for ts in li.TEMPLATES.values() for t in ts] + [" ".join(MIT.split()[:20]), "A licence to fish."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = li.fit(spark, docs)
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    seen = {store.executionsList().apply(i).executionId() for i in range(store.executionsList().size())}
    got = {r["paragraph"]: r for r in li.scan(li.cued(docs), model).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    ran = [store.executionsList().apply(i) for i in range(store.executionsList().size())]
    sizes = [len(x.physicalPlanDescription()) for x in ran if x.executionId() not in seen]
    assert sizes and max(sizes) < 100_000

    def terms(text):
        w = re.findall(li.WORD, text.lower())
        return set(w) | {f"{a} {b}" for a, b in pairwise(w)}

    of = {f: [terms(t) for t in ts] for f, ts in li.TEMPLATES.items()}
    spread = Counter(t for sets in of.values() for t in set().union(*sets))
    weight = lambda s: sum(math.log(1 + len(of) / spread[t]) for t in s)
    named = {p: r for p, r in got.items() if r["family"] != li.UNKNOWN}
    assert len(named) > 40
    for p, r in named.items():
        assert abs(r["cover"] - max(weight(s & terms(p)) / weight(s) for s in of[r["family"]])) < 1e-6


def test_notices_without_words_of_the_law_are_found(spark):
    """A notice that lacks the very word that told notices from other lines, in a line and over lines."""
    prose = "The boat left the harbour in the morning and nobody saw it again."
    granted, forms = MIT.replace("Permission ", ""), BSD.replace("Redistribution and ", "")
    want = [
        (granted, ["MIT"]),
        (f"{prose}\nPer-\n{wrapped('mission ' + granted, 50)}\n{prose}", ["MIT"]),
        (f"{prose} {forms} {prose}", ["BSD"]),
        ("GNU General Public\nVersion 3, 29 June 2007", ["GPL-3.0"]),
        (f"{prose}\nunder the terms of the GNU Affero General Public\n{prose}", ["AGPL"]),
        (prose, []),
        ("The software of this person is free of charge, under the conditions of the author.", []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(want)], "doc_id long, text string")
    got = {r["doc_id"]: r["families"] for r in li.scanned(docs, li.fit(spark, docs)).collect()}
    assert [(t[:60], got[i], f) for i, (t, f) in enumerate(want) if got[i] != f] == []


def test_no_cover_is_reached_without_a_cue():
    def terms(text):
        w = re.findall(li.WORD, text.lower())
        return set(w) | {f"{a} {b}" for a, b in pairwise(w)}

    of = {f: [terms(t) for t in ts] for f, ts in li.TEMPLATES.items()}
    spread = Counter(t for sets in of.values() for t in set().union(*sets))
    weight = lambda s: sum(math.log(1 + len(of) / spread[t]) for t in s)
    bare = lambda s: {t for t in s if not any(re.search(li.CUE, w) for w in t.split(" "))}
    assert max(weight(bare(s)) / weight(s) for sets in of.values() for s in sets) < li.COVER
