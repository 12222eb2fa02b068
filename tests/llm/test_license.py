from notegraph.llm.license import TEMPLATES, Compressors, blocks, differences, licenses, scan, words
from helpers import CLASHING, awkward

NOISE = "Thndou erhaha eaernd ertible erheble eronin eredble aninou shingou thinor bleing eresnttion reennt totheaoued "


def found(text):
    compressors = Compressors(TEMPLATES)
    return [(name, changes) for part in blocks(text) for name, _, changes in licenses(part, compressors)]


def test_every_template_is_found_in_noise():
    for name, text in TEMPLATES.items():
        got = found(NOISE * 3 + "\n" + text + "\n" + NOISE * 3)
        assert (name, []) in got, (name, got)


def test_changed_wording_is_listed():
    got = found(NOISE + TEMPLATES["GPL-3.0-header"].replace("free software", "open software") + " " + NOISE)
    assert got == [("GPL-3.0-header", ["-free", "+open"])]


def test_versions_are_told_apart():
    assert [n for n, _ in found("This work is licensed under the GNU General Public License, version 2.")] == ["GPL-2.0"]
    assert [n for n, _ in found("Licensed under CC BY-SA 4.0.")] == ["CC-BY-SA-4.0"]


def test_two_notices_in_one_block():
    assert {n for n, _ in found(TEMPLATES["MIT"] + " " + TEMPLATES["Apache-2.0"])} == {"MIT", "Apache-2.0"}


def test_complete_notices_behind_longer_partial_ones():
    def part(name):
        return " ".join(w for k, w in enumerate(TEMPLATES[name].split()) if k % 6)

    partial = " ".join(part(n) for n in ("MIT-text", "GPL-3.0-header", "Apache-2.0-header"))
    assert found(partial) == []
    for name in ("Proprietary", "Apache-2.0", "MIT", "CC-BY-4.0"):
        got = found(partial + " " + TEMPLATES[name])
        assert (name, []) in got, (name, got)


def test_names_and_versions_decide():
    lgpl = TEMPLATES["LGPL-3.0"]
    for other in (
        lgpl.replace("version 3", "version 2.1"), lgpl.replace("version 3", "version 2"), lgpl.replace("Lesser", "Affero"),
        TEMPLATES["GPL-3.0-header"].replace("General", "Affero General"), TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"),
        TEMPLATES["CC-BY-NC-4.0"].replace("BY-NC", "BY-NC-ND"),
    ):
        assert found(NOISE + other + " " + NOISE) == [], other
    # A passage of another version does not hide the notice behind it.
    later = lgpl.replace("This work", "That work")
    assert [n for n, _ in found(lgpl.replace("version 3", "version 2.1") + " " + NOISE + later)] == ["LGPL-3.0"]


def test_clean_text_has_none():
    assert found(NOISE * 20) == [] and found("the license plate was stolen") == []


def test_differences():
    share, changes, _ = differences(["a", "b", "c"], ["x", "a", "c"])
    assert 0.6 < share < 0.7 and changes == ["-b"]
    assert [w for w, _, _ in words("CC BY-NC 4.0.")] == ["cc", "by-nc", "4.0"]


def test_awkward_rows(spark):
    rows = [(i, t) for i, t, *_ in awkward()] + [(50, "x " * 50_000 + TEMPLATES["MIT"])]
    docs = spark.createDataFrame([(i, t, "x", 1, "k", "n", "t", "l", "s", "r") for i, t in rows], CLASHING)
    got = {r["doc_id"]: r for r in scan(docs).collect()}
    assert len(got) == len({i for i, _ in rows}) and got[0]["n_blocks"] == 0
    assert got[50]["licenses"] == "MIT" and got[50]["n_exact"] == 1
    assert scan(docs.limit(0)).count() == 0
