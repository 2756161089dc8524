import textwrap

import pytest

from treeline.llm import licences as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def learned(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, L.learn(docs)


def families(model, text):
    return sorted({f["family"] for f in L.scan(model, text) if f["confirmed"]})


def test_every_notice_is_found_in_a_text(learned):
    docs, model = learned
    plain = docs.filter("length(text) > 500").orderBy("doc_id").first().text
    missed = []
    for family, notices in L.NOTICES.items():
        for notice in notices:
            for text in (notice, f"{plain}\n{notice}", f"{plain.split(chr(10))[0]} {notice.upper()} {plain}"):
                if families(model, text) != [family]:
                    missed.append((family, notice[:40]))
    assert len(missed) <= 0.04 * 3 * sum(map(len, L.NOTICES.values())), missed


def test_like_notices_are_none(learned):
    _, model = learned
    assert [families(model, t) for t in L.LIKE_NOTICES] == [[]] * len(L.LIKE_NOTICES)


def test_versions_are_told_apart(learned):
    _, model = learned
    for n in (2, 3):
        assert families(model, f"This work is licensed under the GNU General Public License, version {n}.") == [f"GPL-{n}.0"]


def test_given_documents(learned):
    docs, model = learned
    lines = {"Apache License": "Apache-2.0", "MIT License": "MIT", "General Public License, version 3": "GPL-3.0", "CC BY-NC": "CC-BY-NC"}
    texts = {r.doc_id: r.text for r in docs.collect()}
    some = 0
    for r in L.licences(docs, model).collect():
        text = texts[r.doc_id]
        want = {f for sign, f in lines.items() if sign in text}
        assert {f.family for f in r.findings if f.confirmed} == want
        some += len(want)
        for f in r.findings:
            assert f.start >= 0 and f.end <= len(text) and "\n" not in text[f.start : f.end]
    assert some > 20


@pytest.mark.parametrize("width", [40, 72])
@pytest.mark.parametrize("sign", ["", "# ", " * ", "// ", "-- "])
def test_every_wrapped_notice_is_found(learned, width, sign):
    docs, model = learned
    plain = [r.text.split("\n")[0] for r in docs.filter("length(text) > 500").orderBy("doc_id").limit(2).collect()]
    missed = []
    for family, notices in L.NOTICES.items():
        for notice in notices:
            for text in (notice, f"{plain[0]}\n\n{notice}\n\n{plain[1]}"):
                wrapped = "\n".join(sign + x for line in text.split("\n") for x in textwrap.wrap(line, width) or [""])
                if families(model, wrapped) != [family]:
                    missed.append((family, notice[:40], families(model, wrapped)))
    assert len(missed) <= 0.04 * 2 * sum(map(len, L.NOTICES.values())), missed


def test_wrapped_versions_and_places(learned):
    _, model = learned
    for n in (2, 3):
        text = f"# x\n# This work is licensed under the GNU General Public License,\n# version {n}.\nimport os"
        found = [f for f in L.scan(model, text) if f["confirmed"]]
        assert [(f["family"], f["paragraph"]) for f in found] == [(f"GPL-{n}.0", 1)]
        assert text[found[0]["start"] : found[0]["end"]].split("version ")[1] == str(n)
    text = "İ\nLicensed under the Apache License,\nVersion 2.0\nReleased under the MIT License.\nThe end of the text."
    found = [f for f in L.scan(model, text) if f["confirmed"]]
    assert [text[f["start"] : f["end"]] for f in found] == [
        "Licensed under the Apache License,\nVersion 2.0", "Released under the MIT License"]


def test_places_and_long_paragraphs(learned):
    _, model = learned
    text = "é" * 5 + "\n" + "word " * 5000 + "Licensed under the Apache License, Version 2.0. " + "word " * 5000
    found = L.scan(model, text)
    assert [f["family"] for f in found if f["confirmed"]] == ["Apache-2.0"]
    assert text[found[0]["start"] : found[0]["end"]] == "Licensed under the Apache License, Version 2.0" and found[0]["paragraph"] == 1


def test_odd_tables(spark, learned):
    _, model = learned
    rows = [(1, None), (2, ""), (None, "Released under the MIT License."), (2, "Released under the MIT License.")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, findings string, family int")
    got = L.licences(frame, model).collect()
    assert sorted((str(r.doc_id), len(r.findings)) for r in got) == [("1", 0), ("2", 0), ("2", 1), ("None", 1)]
    assert L.licences(frame.limit(0), model).count() == 0
    assert L.licences(frame, L.learn(frame.limit(0))).count() == len(rows)
