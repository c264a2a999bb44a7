"""Search with its counts, candidates with their filters, twice-encoded text."""

from pyspark.sql import functions as F

from sluicework.operators import quality, search

INDEX = "line long, id string, path string, category string, variants map<string,string>"


def _corpus(spark):
    rows = [
        (1, "a", "p/a/index.md", "x", {"en": "translated", "zh": "failed"}), (2, "b", "p/b/index.md", "x", {"en": "failed"}), (3, "c", "p/c/index.md", "y", {}), (4, "a", "q/other/index.md", "x", {"en": "translated"}),
        (5, "d", "../out/index.md", "x", {"en": "translated"}), (6, "e", "p/e/index.md", "x", None), (7, None, "p/f/index.md", "x", {}), (8, "", "p/g/index.md", "x", {}), (9, "h", None, "x", {}), (10, "i", "/p/i/index.md", "x", {}),
    ]
    bodies = [("p/a/index.en.md", "A word, and the Key here."), ("p/b/index.en.md", "key of a stale file"), ("q/other/index.en.md", "key"), ("p/e/index.en.md", "nothing"), ("p/a/index.md", "original key"), ("p/c/index.md", "key")]
    return spark.createDataFrame(rows, INDEX), spark.createDataFrame(bodies, "path string, text string")


def _run(spark, lang, **how):
    shown, told = search.corpus_search(*_corpus(spark), lang, **how)
    rows = [(r.id, r.path, r.state, r.snippet) for r in shown.collect()]
    return rows, told.get


def test_search(spark):
    rows, n = _run(spark, "en", keyword="KEY")
    assert rows == [("a", "p/a/index.en.md", "present", "A word, and the Key here.")]
    assert n == {"missing": 1, "failed": 1, "invalid": 2, "matched": 1, "truncated": 0}
    rows, n = _run(spark, "en", where=F.col("category") == "x")
    assert [r[0] for r in rows] == ["a", "e"] and n == {"missing": 0, "failed": 1, "invalid": 2, "matched": 2, "truncated": 0}
    assert [r[0] for r in _run(spark, "en", coverage="failed")[0]] == ["a", "b", "e"] and [r[0] for r in _run(spark, "en", coverage="missing")[0]] == ["a", "c", "e"]
    assert [r[0] for r in _run(spark, "en", coverage="failed", keyword="key")[0]] == ["a"]
    rows, n = _run(spark, "orig", keyword="key", limit=1)
    assert [r[:2] for r in rows] == [("a", "p/a/index.md")] and n["matched"] == 2 and n["truncated"] == 1 and n["missing"] == 2
    assert [r[0] for r in _run(spark, "orig", keyword="key", limit=0)[0]] == ["a", "c"]


def test_search_of_nothing(spark):
    index, bodies = _corpus(spark)
    shown, told = search.corpus_search(index.limit(0), bodies, "zh", keyword="k")
    assert shown.collect() == [] and told.get == {"missing": 0, "failed": 0, "invalid": 0, "matched": 0, "truncated": 0}


def test_candidates(spark):
    pool = "id string, status string, has_images boolean, conf string, category string, est int, topics array<string>, contest string, comp_norm string, lang string, head string"
    base = {"id": "0", "status": "ok", "has_images": False, "conf": "mid", "category": "x", "est": 3, "topics": ["Graph theory", "t"], "contest": "IMO 2001", "comp_norm": "imo", "lang": "English", "head": "Let n be"}
    other = [{"id": "1", "status": "skip"}, {"id": "2", "has_images": True}, {"id": "3", "conf": "low"}, {"id": "4", "category": "y"}, {"id": "5", "est": 1}, {"id": "6", "topics": ["other"]}, {"id": "7", "contest": None, "comp_norm": None}, {"id": "8", "lang": "French"}, {"id": "9", "head": None}, {"id": "A", "conf": "high"}, {"id": "B", "est": 2, "comp_norm": "zz"}, {"id": "C", "conf": None}]
    rows = [tuple((base | o)[c.split(" ")[0]] for c in pool.split(", ")) for o in [{}, *other]]
    df = spark.createDataFrame(rows, pool)

    def ids(**how):
        shown, told = search.candidates(df, **how)
        return "".join(r.id for r in shown.collect()), told.get

    assert ids(limit=0) == ("BA046897", {"matched": 8, "truncated": 0})
    assert ids(limit=3) == ("BA0", {"matched": 8, "truncated": 5})
    assert ids(images=True, conf="low", difficulty=(1, 5), limit=0)[0] == "5BA02468973"
    assert ids(category="y")[0] == "4" and ids(node="Graph")[0] == "BA04897" and ids(contest="imo")[0] == "BA04689" and ids(lang="fren")[0] == "8" and ids(grep="^let")[0] == "BA04687"
    assert [r.r for r in spark.createDataFrame([("low",), ("high",), ("mid",), ("?",), (None,)], "c string").select(search.confidence_rank(F.col("c")).alias("r")).collect()] == [0, 2, 1, None, None]


def test_mojibake(spark):
    texts = ["plain", "héllo wörld", "hÃ©llo", "求所有", "æ±‚", "�", "Â ", "é\x80è\x81ê\x82", "`hÃ©`", "$Ã©$ x", "", None, "français où là"]
    texts.append("每个正整数".encode().decode("latin-1"))
    got = quality.mojibake(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "t").orderBy("k").collect()
    assert [r.wrong for r in got] == [False, False, True, False, False, True, True, True, False, False, False, False, False, True]
    assert got[2].repaired == 1 and got[2].markers == 1 and got[7].repaired == 0 and got[13].repaired == 1 and got[3].markers == 0
    back = spark.createDataFrame([("hÃ©",), ("hé",), ("求",), ("ab",), (None,)], "t string").select(quality.decoded_back(F.col("t")).alias("b")).collect()
    assert [r.b for r in back] == ["hé", None, None, "ab", None]
