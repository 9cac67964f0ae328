"""Mojibake and look-alikes: round trips over encodings, canonical classes, odd inputs."""

import random
from collections import Counter

import pytest

from slatework.llm import lookalike as L
from slatework.llm import mojibake as M

GIVEN = ["Jürgen", "Søren", "Håvard", "Lukáš", "Jiří", "Rémi", "Noël", "Łukasz", "Peter", "Anders", "Viktor", "João"]
LAST = ["Lindström", "Dvořák", "Björkman", "Höglund", "Kovář", "Nygård", "Ångström", "Šimek", "Černý", "Müller", "Garcia", "Brown", "Sjöberg", "Őry", "Wałęsa"]
CLEAN = [f"{g} {s}" for g in GIVEN for s in [*LAST, "O'Brien"]]


@pytest.fixture(scope="module")
def decoder():
    counts = M.Counter(g for n in CLEAN * 5 for g in M._grams(n))
    return M.Decoder(M.Language(counts))


def _wrong(text, written, read):
    return M._read_as(text.encode(written), read)


@pytest.mark.parametrize("read", ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850"])
def test_utf8_round_trip(decoder, read):
    for name in CLEAN:
        pair, back, whole, _, sure = M.label_one(decoder, _wrong(name, "utf-8", read))
        if name.isascii():
            assert pair is None
        else:
            assert pair
            assert sure
            assert whole
            assert back == name


def test_twice_and_lost(decoder):
    for name in [n for n in CLEAN if not n.isascii()]:
        assert M.label_one(decoder, _wrong(_wrong(name, "utf-8", "cp1252"), "utf-8", "cp1252"))[1] == name
    pair, back, whole, *_ = M.label_one(decoder, "S�ren Lindstr?m")
    assert (pair, back, whole) == ("lost", "S�ren Lindstr?m", False)
    assert M.label_one(decoder, "?????? ????")[0] == "lost"


def test_clean_stays(decoder):
    for name in [*CLEAN, "Петер Линдстрём", "Soren Lindstrom", "", None, "JOÃO ŠIMEK", "Jоhn Вrown", "Ｐｅｔｅｒ Brown", "A​nders Brown", "O’Brien Brown"]:
        assert M.label_one(decoder, name)[0] is None, name
    assert M.label_one(decoder, "Петер Линдстром".encode().decode("latin-1"))[0]


def test_labels_in_spark(spark):
    rows = [(i, n, "clash") for i, n in enumerate(CLEAN * 3)] + [(900, _wrong("Jürgen Dvořák", "utf-8", "cp1252"), ""), (901, None, ""), (902, "", ""), (903, "ž" * 3000, ""), (904, _wrong("Lukáš Kovář", "iso8859-2", "latin-1"), "")]
    df = spark.createDataFrame(rows, "id long, name string, damage string")
    got = {r["id"]: r["damage"] for r in M.label_names(df, "id").collect()}
    assert {i for i, d in got.items() if d["pair"]} == {900, 904}
    assert got[900]["restored"] == "Jürgen Dvořák"
    assert got[904]["restored"] == "Lukáš Kovář"
    assert (got[901]["restored"], got[902]["restored"]) == (None, "")
    assert M.label_names(df.limit(0), "id").count() == 0


def test_canonical_forms(spark):
    odd = {
        "Ｂjörn Ek": "Björn Ek", "Björn Ek": "Björn Ek", "Björn Ek": "Björn Ek", "Bj​örn E­k": "Björn Ek", "Вjörn Εk": "Björn Ek", "O’Hara‐Ek": "O'Hara-Ek",
    }
    same = ["Björn Ek", "BJÖRN EK", "Björn  Ek", "Bjorn Ek", "Пётр", "Αλέξης Παπάς", "", "Bj¶rn", "ß"]
    df = spark.createDataFrame([(v,) for v in [*odd, *same, None, *same]], "value string")
    got = {r["value"]: r["form"] for r in L.canonical_forms(df).collect()}
    assert got == {**odd, **{s: s for s in same if s not in ("Пётр", "Αλέξης Παπάς")}, **{k: got[k] for k in ("Пётр", "Αλέξης Παπάς")}, None: None}
    rows = spark.createDataFrame([(i, v, "clash", "clash") for i, v in enumerate([*odd, *same, None, "ｘ" * 5000])], "id long, value string, form string, mapped string")
    hit = {r["id"]: r["form"] for r in L.odd_spellings(rows, ["id"], "value").collect()}
    assert hit == {**dict(enumerate(odd.values())), len(odd) + len(same) + 1: "x" * 5000}
    assert L.odd_spellings(rows.limit(0), ["id"], "value").count() == 0


def test_letters_beyond_the_first_plane_and_numbers_in_circles(spark):
    names = spark.createDataFrame([(1, "𝐁o Ek"), (2, "Ｂo Ek"), (3, "Line ⑩"), (4, "ﬁ Ek"), (5, "Bo™ Ek"), (6, "Bo Ek")], "id long, v string")
    got = {r["id"]: r["form"] for r in L.odd_spellings(names, ["id"], "v").collect()}
    assert got == {1: "Bo Ek", 2: "Bo Ek", 3: "Line 10", 4: "fi Ek"}


def test_states_of_a_shared_beginning_are_kept():
    language = M.Language(Counter(g for n in ("josé garcía", "jürgen müller", "anna lind") for g in M._grams(n)))
    r = random.Random(3)
    parts = ["José", "JosÃ©", "GarcÃ\xada", "MÃ¼ller", "Müller", "Lind", "Иван", "M?ller", "Ã", "Ã¼", "Å"]
    names = [" ".join(r.choices(parts, k=r.randint(1, 3)))[: r.randint(1, 20)] for _ in range(400)]
    kept = M.Decoder(language)
    for name in names + sorted(names):
        assert M.label_one(kept, name) == M.label_one(M.Decoder(language), name)
    kept.decode("José MÃ¼ller", frozenset())
    before = kept.last[2][:]
    kept.decode("José MÃ¼lner", frozenset())
    assert all(a is b for a, b in zip(before[:10], kept.last[2][:10], strict=True))
