"""Toxicity, personal data and licenses."""

import random
import re
import time
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from crawlens.llm import licenses, pii, toxicity


def plain_spans(text):
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for kind, pattern, low, high in (("card", r"[0-9]([\x20-]?[0-9])+", 14, 19), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 10, 15)):
        for m in re.finditer(pattern, text):
            digits = [int(c) for c in m.group() if c.isascii() and c.isdigit()]
            luhn = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits))) % 10 == 0
            if low <= len(digits) <= high and (kind == "phone" or luhn):
                found.append((kind, *m.span()))
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_plain_identifiers_as_by_the_patterns():
    r = random.Random(1)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@+- ()9025é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    for text in ("4111 1111 1111 1111", "+1 (555) 010-9999", "x@y.z.", "1.2.3.4.5.6.7.8", "a@b@c.de", "٣@é.com 300.1.1.1"):
        assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("mail john.doe (at) example [dot] com now", "email", "john.doe (at) example [dot] com"),
        ("write to jane at example dot com please", "email", "jane at example dot com"),
        ("\u0440\u0430ul@\u0435x\u0430mple.com!", "email", "\u0440\u0430ul@\u0435x\u0430mple.com"),
        ("x\U0001f642 jo\u200bhn@exa\u200bmple.com", "email", "jo\u200bhn@exa\u200bmple.com"),
        ("call plus four nine one five one two three four five six seven", "phone", "plus four nine one five one two three four five six seven"),
        ("card four one one one 1111 1111 one one one one.", "card", "four one one one 1111 1111 one one one one"),
        ("host one nine two dot one six eight dot one dot one", "ip", "one nine two dot one six eight dot one dot one"),
        ("\uff4a\uff4f\uff45\uff20\uff45\uff58\uff41\uff4d\uff50\uff4c\uff45\uff0e\uff43\uff4f\uff4d", "email", "\uff4a\uff4f\uff45\uff20\uff45\uff58\uff41\uff4d\uff50\uff4c\uff45\uff0e\uff43\uff4f\uff4d"),
    ],
)
def test_disguises_map_back_to_the_source(text, kind, piece):
    base = pii.base_spans(text)
    assert [(k, text[s:e]) for k, s, e in pii.added_spans(text, base)] == [(kind, piece)]
    assert pii.masked(text, pii.added_spans(text, base)) == text.replace(piece, f"<{kind}>")


@pytest.mark.parametrize(
    "text, kind, piece",
    [
        ("to j\u043ehn@example.com now", "email", "j\u043ehn@example.com"),
        ("to john@example.c\u043em now", "email", "john@example.c\u043em"),
        ("to jane[dot]doe@example.com now", "email", "jane[dot]doe@example.com"),
        ("to jane dot doe@example.com now", "email", "jane dot doe@example.com"),
        ("to john@example dot com now", "email", "john@example dot com"),
        ("to jane dot doe@mail.example dot co dot uk now", "email", "jane dot doe@mail.example dot co dot uk"),
        ("on 192 dot 168 dot 0 dot 1 now", "ip", "192 dot 168 dot 0 dot 1"),
        ("on 192.168 dot 0.1 now", "ip", "192.168 dot 0.1"),
        ("on 192 dot one six eight dot 0 dot 1 now", "ip", "192 dot one six eight dot 0 dot 1"),
    ],
)
def test_half_disguised_identifiers_are_masked_whole(text, kind, piece):
    base = pii.base_spans(text)
    added = pii.added_spans(text, base)
    assert [(k, text[s:e]) for k, s, e in added] == [(kind, piece)]
    assert pii.masked(text, base + added) == text.replace(piece, f"<{kind}>")


def test_prose_around_plain_identifiers_is_left_alone():
    for text in ("mail a@b.co at this point jane@example.com point final", "1 dot 2 dot 3", "300 dot 300 dot 300 dot 300", "4111 1111 1111 1111 dot one", "host 10.0.0.1 dot"):
        assert pii.added_spans(text, pii.base_spans(text)) == [], text


def test_prose_is_left_alone():
    for text in ("look at example.com for it", "we met at noon at the dot", "one two three go", "at dot at dot", "Version 1.2.3 of zero one", "a [dot] in (at) brackets"):
        assert pii.added_spans(text, pii.base_spans(text)) == []


def test_long_texts_take_linear_time():
    began = time.perf_counter()
    for text in ("a" * 2_000_000, "a@" * 500_000, "1" * 1_000_000, "+1(" * 300_000, "1." * 500_000, "one " * 100_000, "a dot " * 100_000):
        pii.added_spans(text, pii.base_spans(text))
    assert time.perf_counter() - began < 60


def test_personal_data_of_odd_rows(spark):
    rows = [(1, "a@b.co"), (1, "a@b.co"), (None, "x"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"base": F.lit(1), "added": F.lit(2)})
    found = pii.find_personal_data(df).collect()
    assert Counter((r.doc_id, tuple((s.kind, s.start, s.end) for s in r.base), len(r.added)) for r in found) == Counter(
        [(1, (("email", 0, 6),), 0)] * 2 + [(None, (), 0), (2, (), 0), (3, (), 0)]
    )
    assert pii.find_personal_data(df.limit(0)).count() == 0


def test_licenses_are_found_with_their_wording():
    for license_id, text in licenses.TEXTS.items():
        changed = text.replace("software", "program", 1)
        found = licenses.licenses_in("Prose before it.\n\nCopyright (c) 2020 Foo\n\n" + changed + "\n\nMore prose. " * 40)
        assert [(f[0], f[5]) for f in found] == [(license_id, [] if changed == text else ["-software", "+program"])]
    text = "Some prose.\nReleased under the MIT License.\nMore, licensed under CC BY-NC 4.0. End. This work is licensed under the GNU General Public License, version 3."
    assert [(f[0], text[f[1] : f[2]]) for f in licenses.licenses_in(text)] == [
        ("MIT", "Released under the MIT License"), ("CC-BY-NC-4.0", "licensed under CC BY-NC 4.0"), ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ]
    for text in ("", "a licensed plumber with permission", "Licensed under CC BY-SA 3.0.", "Released under the Foo License.", "license " * 3000):
        assert licenses.licenses_in(text) == []
    assert [f[0] for f in licenses.licenses_in("Released under the MIT License. " * 30)] == ["MIT"] * 30


def test_license_names_and_versions_are_not_differences():
    header = licenses.TEXTS["GPL-3.0"]
    for text, license_id in (
        (licenses.TEXTS["GPL-2.0"], "GPL-2.0"), (header.replace("version 3", "version 2"), "GPL-2.0"), (header.replace("GNU General", "GNU Affero General"), "AGPL-3.0"),
        (header.replace("GNU General", "GNU Lesser General"), "LGPL-3.0"), (header, "GPL-3.0"), (licenses.TEXTS["BSL-1.0"], "BSL-1.0"),
    ):
        assert [f[0] for f in licenses.licenses_in("Prose.\n\n" + text + "\n\nMore.")] == [license_id]
    assert licenses.licenses_in(header.replace("version 3", "version 7")) == []


def test_spdx_identifiers_and_short_names():
    for text, found in (
        ("// SPDX-License-Identifier: MIT\nint x;", ["MIT"]), ("# SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-2.0-or-later", ["MIT", "Apache-2.0", "GPL-2.0"]),
        ("SPDX-License-Identifier: MIT-0", []), ("SPDX-License-Identifier: Foo", []), ("SPDX-License-Identifier: MIT see Apache-2.0", ["MIT"]),
        ("It is licensed under MIT.", ["MIT"]), ("Released under GPLv3, so", ["GPL-3.0"]), ("Licensed under Apache 2.0", ["Apache-2.0"]), ("study under MIT supervision, licensed", []),
    ):
        assert [f[0] for f in licenses.licenses_in(text)] == found, text


def test_license_scan_of_odd_rows(spark):
    rows = [(1, "Released under the MIT License."), (1, "Released under the MIT License."), (2, None), (3, ""), (None, "Licensed under CC BY 4.0")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"license": F.lit(1), "start": F.lit(2)})
    assert Counter((r.doc_id, r.license, r.n_differences) for r in licenses.scan_licenses(df).collect()) == Counter([(1, "MIT", 0), (1, "MIT", 0), (None, "CC-BY-4.0", 0)])
    assert licenses.scan_licenses(df.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(2)
    words = ["the", "you", "house", "Garden", "walk", "tree.", "river", "and", "of", "stone"]
    rows, labels = [], []
    for i in range(1200):
        own = [r.choice(words) for _ in range(r.randint(20, 120))]
        toxic = int(i % 5 == 0)
        for _ in range(toxic * r.randint(1, 4)):
            own[r.randrange(len(own))] = r.choice(["scumbag", "SCUMMER", "scumlord!", "blockhead", "dimwit"])
        rows.append((i, " ".join(own)))
        labels.append((i, 1, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_of_held_out_texts(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    found = toxicity.score_documents(docs.withColumns({"toxic": F.lit("x"), "features": F.lit(1), "raw": F.lit(2), "score": F.lit(3), "prediction": F.lit(0)}), model).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == r.toxic for r in held) > 0.95 * len(held)
    kept = toxicity.keep_harmless(docs.withColumn("score", F.lit("own")), model)
    assert kept.columns == ["doc_id", "text", "score"] and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if not r.predicted}
    # The held-out labels are never looked at.
    flipped = labels.withColumn("toxic", F.when(toxicity.fold(F.col("doc_id")) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, flipped)).collect()}
    assert again == {r.doc_id: r.score for r in found}


def test_toxicity_of_odd_rows(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(docs, labels)
    odd = spark.createDataFrame([(None, "scumbag"), (1, None), (2, ""), (3, " \n"), (4, "you dimwit " * 60_000), (4, "x" * 100_000)], "doc_id long, text string")
    found = toxicity.score_documents(odd, model).collect()
    assert len(found) == 6 and all(0 <= r.score <= 1 for r in found)
    assert len({r.score for r in found if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score_documents(odd.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("toxic = 0")):
        assert {r.score for r in toxicity.score_documents(odd, toxicity.fit(docs, few)).collect()} == {0.0}
    assert toxicity.score_documents(odd, toxicity.fit(docs.limit(0), labels)).count() == 6


def test_disguised_words_are_uncovered():
    assert toxicity.uncovered("1d.1-0t!!") == "idiot" and toxicity.uncovered("stuuuupid") == "stupid"
    features = toxicity.Features({("word", "idiot"): 5.0})
    named = dict(zip(toxicity.FEATURES, features.of("you are an 1d10t today")))
    assert named["hidden_density"] > 0 and named["obfuscation_rate"] > 0 and named["strong_density"] == 0
