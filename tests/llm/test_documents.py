"""Leakage, residue and mixing: brute force, traps, odd inputs."""

import random

import pandas as pd
import pytest

from slatework.llm import leakage as G
from slatework.llm import mixture as X
from slatework.llm import residue as R

DOC = "doc_id long, text string, item_id string, seg string, notice string"


def _docs(spark, texts):
    return spark.createDataFrame([(i, t, "clash", "clash", "clash") for i, t in enumerate(texts)], DOC)


def _items(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "item_id long, text string, doc_id string")


def _edit(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [row[0] + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row


def test_myers_against_dynamic_programming():
    import numpy as np

    r = random.Random(3)
    for _ in range(300):
        p = [r.randint(0, 3) for _ in range(r.randint(1, 70))]
        t = [r.randint(0, 3) for _ in range(r.randint(0, 90))]
        assert G.myers(np.array(p, np.uint64), np.array(t, np.uint64)) == min([len(p), *_edit(p, t)])


def test_words():
    assert G.plain_words("L'Été “ŁØ” re­bound 3.5-Ｂ!") == ["l", "ete", "lo", "rebound", "3", "5", "b"]
    assert G.plain_words(None) == G.plain_words("  …  ") == []


def test_leaks_against_brute_force(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(60)]
    items = [" ".join(r.choices(vocab, k=r.choice([5, 12, 40]))) for _ in range(20)]
    docs = []
    for _ in range(120):
        words = r.choices(vocab, k=r.randint(0, 60))
        src, n = r.choice(items).split(), r.randint(6, 14)
        at = r.randint(0, max(0, len(src) - n))
        docs.append(" ".join(words + [w.upper() + "," for w in src[at : at + n]] + r.choices(vocab, k=5)))
    docs += [None, "", docs[0], "x " * 50_000 + items[2]]
    got = {(x["doc_id"], x["item_id"]) for x in G.leaked_items(_docs(spark, docs), _items(spark, [*items, None, ""])).collect()}
    grams = lambda t: {tuple(w[i : i + 10]) for w in [G.plain_words(t)] for i in range(len(w) - 9)}
    ig = [grams(t) for t in items]
    want = {(d, i) for d, t in enumerate(docs) for g in [grams(t)] for i, h in enumerate(ig) if g & h}
    assert got == want
    blocks = {(x["doc_id"], x["item_id"]) for x in G.find_leaks(_docs(spark, docs), _items(spark, items), block_words=100).where("run >= 10").collect()}
    assert blocks == want


def test_edited_passage(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = ["a b w0 w1 w2 w3 w4 w5 OTHER w7 w8 w9 c", "w0 w1 w2 w3 w4 x y z w8 w9 w10"]
    got = {(r["doc_id"], r["errors"]) for r in G.find_leaks(_docs(spark, docs), _items(spark, [item])).collect()}
    assert got == {(0, 1)}
    report = G.leak_report(_docs(spark, docs), _items(spark, [item])).first()
    assert (report["exact_docs"], report["edited_docs"]) == (0, 1)
    assert G.leaked_items(_docs(spark, []), _items(spark, [])).count() == 0
    with pytest.raises(ValueError, match="two words"):
        G.find_leaks(_docs(spark, []), _items(spark, []), 3, 2)


RESIDUE = [
    "Final: {{ team }} by 4.", "It was [INSERT TEAM] again", "He took %HEADLINE% shots", "the <%= score %> half wall", "<!-- insert quote -->", "(goals TBD) this week", "took TK TK and left", "a ${city} win",
    "PLEASE ENABLE JAVASCRIPT TO CONTINUE.", "Error 503: no answer", "long recap and then Your session has expired. more", "Lorem ipsum dolor amet tincidunt", "asdf asdf asdf", "TODO: summary of A against B.", "Seite nicht gefunden – Fehler 404",
    "Hello ((name)), welcome back.", "This page is temporarily unavailable, we are working on it.", "Vous devez autoriser le JavaScript pour lire cet article.", "Der Dienst ist gerade nicht erreichbar.", "he took undefined shots",
]
CONTENT = [
    "Our template has a field called {{player}} which the script fills in.", "Slots are {C, LW} or {D} here, and [G] counts double.", "Save percentage of 39.7% [sic] said the wire.", "He signs as __Bo Ek__ on the forum.",
    "50% of shots, 30% of goals, rest on <b>Bo</b>.", "Goalies who faced 404 shots are rare; the page of history is his.", "It was an error by Bo, and the puck was not found.", "Access to the rink was denied for 9 minutes.",
    "The board is one page of JavaScript, so it is fast.", "Placeholder pick or not, he is fair.", "Cookies were served.", "", None,
    "the goalie said please try again later to the reporter and smiled", "Scripts and cookies were sold at the rink.", "the role was left undefined by the coach", "Undefined roles in the lineup.", "He is a placeholder for the injured centre.",
]


def test_residue(spark):
    got = {r["doc_id"] for r in R.find_residue(_docs(spark, RESIDUE + CONTENT)).collect()}
    assert got == set(range(len(RESIDUE)))
    assert R.find_residue(_docs(spark, [])).count() == 0
    assert R.find_residue(_docs(spark, ["x" * 500_000 + " {{team}}", "fine"])).collect()[0]["doc_id"] == 0


def test_filler_with_common_words(spark):
    texts = ["Lorem ipsum dolor sit amet.", "Lorem ipsum dolor sit amet, sed do eiusmod tempor", "Sit, sed sit sed.", "They sit. Sed is an editor, and they sit there.", "He said lorem ipsum once."]
    assert {r["doc_id"] for r in R.find_residue(_docs(spark, texts)).collect()} == {0, 1, 2}


def test_labels_spread_through_components(spark):
    seed = "please log in again to continue reading here the rest of this very long members only story about the league and its many teams on our site today"
    near = seed.replace("please log in", "sign in")
    far = near + " friends"
    docs = [seed, f"A recap.\n{near}", far, "something else entirely that has words of its own and no end to them at all for now"]
    got = {r["doc_id"]: (r["notice"], r["spread"]) for r in R.find_residue(_docs(spark, docs)).collect()}
    assert got[0] == (True, False)
    assert got[2] == (False, True)  # linked to the seed by the second document only
    assert got[1] == (False, True)
    assert 3 not in got


@pytest.mark.parametrize("front", [0, 5000])
def test_a_sentence_is_no_residue_by_a_copy_with_a_notice(spark, monkeypatch, front):
    monkeypatch.setattr(R, "FRONT", front)
    base = " ".join(f"word{i}" for i in range(27))
    popular = "eligibility matters more than you think this spring and spots dry up fast"
    docs = [f"{base} internal error", f"{base} indeed", base, f"{popular} access denied", popular]
    assert {r["doc_id"] for r in R.find_residue(_docs(spark, docs)).collect()} == {0, 3}


def test_a_broadcast_front_holds_no_texts(spark, monkeypatch):
    sent, broadcast = [], R.F.broadcast
    monkeypatch.setattr(R.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    words = " ".join(f"w{i}" for i in "abcdefghijklmnopqrstuvwxyz")
    docs = [f"{words} an administrator has been notified", f"{words} an administrator was notified"]
    assert {r["doc_id"] for r in R.find_residue(_docs(spark, docs)).collect()} == {0}
    assert sent and all(kind != "string" for df in sent for _, kind in df.dtypes)


def test_other_punctuation_of_a_notice(spark):
    docs = ["Please try again later.", "Please -- try again: later!", "he said please try again some time later"]
    assert {r["doc_id"] for r in R.find_residue(_docs(spark, docs)).collect()} == {0, 1}


def test_notices_in_unknown_words_are_found_by_their_company(spark, monkeypatch):
    """With half of the notices unknown, those that share pages with known ones are found, and no content is."""
    monkeypatch.setattr(R, "NOTICES", R._any((r"\baccess denied\b",)))
    pages = ["Access denied.\nKindly contact the keeper of this site.\nRef 1", "Access denied.\nYour address was put on the list.\nRef 2"]
    docs = [f"{pages[i % 2]}\nRecap {i} of game{i} number{i} here" for i in range(20)]
    late = ["Kindly contact the keeper of this site.", "Recap.\nYour address was put on the list.", "The keeper of the net was kind.", "Ref 3"]
    got = {r["doc_id"]: r["spread"] for r in R.find_residue(_docs(spark, docs + late)).collect()}
    assert set(got) == {*range(20), 20, 21}
    assert [got[20], got[21]] == [True, True]


def test_tables_find_near_duplicates(spark):
    """Recall of pairs of similarity 0.8 and more against brute force, and no unlike pair within the radius."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    base = [r.choices(words, k=60) for _ in range(150)]
    texts = [(2 * i + k, " ".join(b if k == 0 else [*b[: 57 - i % 2], "new", *b[58 - i % 2 :]])) for i, b in enumerate(base) for k in (0, 1)]
    rows = spark.createDataFrame(texts, "id long, seg string").withColumn("hash", R.simhash("seg"))
    grams = {i: {tuple(w[j : j + 5]) for w in [t.split()] for j in range(len(w) - 4)} for i, t in texts}
    alike = lambda a, b: len(grams[a] & grams[b]) / len(grams[a] | grams[b])
    want = {(2 * i, 2 * i + 1) for i in range(150) if alike(2 * i, 2 * i + 1) >= 0.8}
    x, y = (R.bands(rows, k).selectExpr("band", "bits", "size", f"id as {n}", f"hash as h{n}") for k, n in enumerate("ab"))
    near = x.join(y, ["band", "bits", "size"]).where("a < b").where(R.distance(R.F.col("ha"), R.F.col("hb")) <= R.RADIUS).select("a", "b").distinct()
    got = {tuple(p) for p in near.collect()}
    assert len(want) > 100
    assert len(want & got) >= 0.95 * len(want)
    assert all(b == a + 1 and a % 2 == 0 for a, b in got)


def test_rake():
    cells = pd.DataFrame([(s, g, t, 100 + 7 * i) for i, (s, g, t) in enumerate((s, g, t) for s in "abc" for g in ("en", "sv") for t in (0, 1))], columns=["source", "lang", "topic", "tokens"])
    cap = {"a": 1, "b": 3, "c": 2}
    out = X.rake(cells, {"a": 0.2, "b": 0.5, "c": 0.3}, cap)
    used = (out["weight"] * out["tokens"]).groupby(out["source"]).sum()
    assert (used / used.sum()).round(6).to_dict() == {"a": 0.2, "b": 0.5, "c": 0.3}
    assert (out["weight"] <= out["source"].map(cap) + 1e-9).all()
    for c in ("lang", "topic"):
        share = (out["weight"] * out["tokens"]).groupby(out[c]).sum() / used.sum()
        assert (share - cells.groupby(c)["tokens"].sum() / cells["tokens"].sum()).abs().max() < 0.02
    assert (X.rake(cells, {}, {})["weight"] == 0).all()


def test_topics_are_fitted_on_all_documents(spark, monkeypatch):
    fitted = []

    class Counted(X.KMeans):
        def fit(self, rows):
            fitted.append((rows.count(), rows.rdd.getNumPartitions()))
            return super().fit(rows)

    monkeypatch.setattr(X, "KMeans", Counted)
    docs = spark.range(25_000).selectExpr("id as doc_id", "concat('topic', char(97 + id % 8), ' words here') as text")
    topics = X.assign_topics(X.count_terms(docs))
    assert topics.count() == 25_000
    assert [n for n, _ in fitted] == [25_000]
    assert fitted[0][1] > 1


def test_mix(spark):
    r = random.Random(6)
    words = ["goal", "puck", "shift", "draft", "trade", "save", "tier", "wing"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(5, 60))), ("a", "a", "a", "b", None, "z")[i % 6], ("en", "sv", None)[i % 3], "clash", "clash") for i in range(600)]
    rows += [(1000, None, "a", "en", "", ""), (1001, "", "b", "en", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string, tokens string")
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 3), ("gone", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = X.mix(docs, targets).collect()
    used = {s: sum(x["tokens"] * x["copies"] for x in got if x["source"] == s) for s in "ab"}
    assert abs(used["a"] / sum(used.values()) - 0.6) < 0.01
    assert max(x["copies"] for x in got if x["source"] == "a") == 1
    assert max(x["copies"] for x in got if x["source"] == "b") <= 3
    assert {x["source"] for x in got} == {"a", "b"}
    assert len({x["doc_id"] for x in got}) == len(got)
    assert [tuple(x) for x in X.mix(docs.repartition(7), targets).select("doc_id", "copies").orderBy("doc_id").limit(0).collect()] == []
    report = {(x["dimension"], x["value"]): x["share"] for x in X.mix_report(docs, targets).collect()}
    assert abs(report["source", "a"] - 0.6) < 0.01
    assert report["source", "gone"] == 0
    assert X.mix(docs.limit(0), targets).count() == 0
    assert X.mix(docs, targets.limit(0)).count() == 0
