"""Each operator against a plain version, on a table with nulls, empty and long texts, ties, repeats and extra columns."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from sluicework.llm import hnsw, html_blocks, mixing, order_minhash, pieces, repeats, secrets, shingles, simhash, surrogates, toxicity

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, row string, id string, size string"


def _rows():
    rng = random.Random(1)
    words = ["alpha", "Beta", "gamma", "délta", "漢字", "😀", "the", "of"]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    texts += [texts[0], texts[0] + " x", None, "", "   ", "a", texts[1] * 40, texts[2] + texts[3], "password: abcdef1 deadbeefdeadbeefdeadbeef mail a.b@c.example.com"]
    rows = [(k, t, f"s{k % 3}" if k % 7 else None, "en", 0, "r", "i", "z") for k, t in enumerate(texts)]
    return rows + [rows[5], (None, texts[4], "s0", None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def _prints(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_mixing(spark, docs, none):
    own = lambda d: mixing.mix_sources(d, mixing.word_count(F.col("text")), F.col("source"), F.col("doc_id"))
    got = own(docs).collect()
    assert len(got) == len(_rows()) and own(none).count() == 0
    assert all(0 <= r.copies <= 2 for r in got)
    for s in {r.row.source for r in got}:
        mine = [r for r in got if r.row.source == s]
        assert abs(sum(r.copies * r["size"] for r in mine) - mine[0].target) <= 2 * max(r["size"] for r in mine)
    view = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", view)
    want = con.sql(mixing.SQL).df()
    key = lambda rows: Counter((None if i != i or i is None else int(i), int(n), round(t, 6)) for i, n, t in rows)
    assert key((r.row.doc_id, r["size"], r.target) for r in got) == key(zip(want.doc_id, want["size"], want.target, strict=True))


@pytest.mark.parametrize("most", [3, simhash.BLOCK])
def test_simhash_links_are_whole(spark, most):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    prints = {b ^ sum({1 << rng.randrange(64) for _ in range(rng.randint(0, 4))}) for b in base for _ in range(30)} | {0, 7, (1 << 64) - 1}
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    found = simhash.near_links(spark.createDataFrame(signed, "fp long"), most).collect()
    def groups(nodes, edges):
        up = {n: n for n in nodes}
        def top(x):
            while up[x] != x:
                x = up[x]
            return x
        for a, b in edges:
            up[top(a)] = top(b)
        return {frozenset(n for n in nodes if top(n) == top(m)) for m in nodes}
    all_ = [s for s, in signed]
    near = [(a, b) for a in all_ for b in all_ if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3]
    assert groups(all_, [(r.a, r.b) for r in found]) == groups(all_, near)


def test_simhash(docs, none):
    got = simhash.near_duplicates(docs).collect()
    text = {r[0]: r[1] for r in _rows()}
    assert len(got) == len(_rows()) and simhash.near_duplicates(none).count() == 0
    assert all((r.fp & (1 << 64) - 1) == _prints(text[r.id]) for r in got if r.id is not None)
    by = {r.id: r.component for r in got}
    assert by[40] == 0 and by[42] == by[43] == by[44] == 42
    one = simhash.one_of_each(docs)
    assert one.columns == docs.columns and one.count() == len({r.group for r in got})


@pytest.mark.parametrize("block", [3, shingles.BLOCK])
def test_near_copies_leave_one(spark, block, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", block)
    rng = random.Random(9)
    texts = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([60, 120, 400]))]
        for changes in (0, 0, 1, 1, 2, 3, 5, 8):
            own = list(base)
            for k in rng.sample(range(len(own)), changes):
                own[k] = "changed"
            texts.append(" ".join(own))
    slow = [f"w{rng.randrange(5000)}" for _ in range(100)]
    for k in range(0, 96, 3):  # a chain: each is near the next, but not the first the last
        slow[k : k + 3] = [f"z{k}"] * 3
        texts.append(" ".join(slow))
    texts += ["a b", "A  b", "b a", None, " "]
    rows = list(enumerate(texts))
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set() for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) > 0:
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.component for r in shingles.near_duplicates(df).collect()}
    assert got == dict(enumerate(group))
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()) == sorted(set(group))


def _cut_plainly(rows):
    """(id, bytes, removed, spans, digest of what is left) of (id, text) by a table of all 50-byte strings."""
    rows = [(i if i is not None else 1 << 62, (t or "").encode()) for i, t in rows]
    first, want = {}, Counter()
    for i, b in rows:
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    for i, b in rows:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < i:
                gone[p : p + 50] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        want[(i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=False) if not g)).hexdigest())] += 1
    return want


def _as_cut(rows):
    return Counter((r.id if r.id is not None else 1 << 62, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in rows)


def test_repeats(spark, docs, none):
    got = repeats.remove_repeats(docs).collect()
    assert _as_cut(got) == _cut_plainly(r[:2] for r in _rows())
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_removed for r in got) and repeats.remove_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [2, repeats.HOT])
def test_repeats_across_blocks(spark, hot):
    """A common line in other contexts, texts of one letter, near copies, bytes of zero and repeats within a document, over many blocks."""
    rng = random.Random(8)
    line, passage = "".join(rng.choices("abcdef ", k=75)), "".join(rng.choices("xyz ", k=400))
    noise = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzäß漢 ", k=n))
    texts = [noise(rng.randint(0, 150)) + line + noise(rng.randint(0, 150)) for _ in range(60)]
    texts += [noise(40) + passage[rng.randint(0, 200) : rng.randint(250, 400)] + noise(30) for _ in range(30)]
    texts += ["a" * 700, "a" * 300, "ab" * 400, "\0" * 200, "\0" * 60 + "x", noise(100) * 3, None, "", texts[3], texts[3] + "!", texts[5][:80], line, line[:49], line[:50]]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    got = repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), hot=hot).collect()
    assert _as_cut(got) == _cut_plainly(rows)


def test_previous_factors():
    """Suffix order, shared lengths and longest previous factors of random strings, against plain comparison."""
    rng = np.random.default_rng(3)
    for _ in range(30):
        raw = np.concatenate([rng.integers(0, 2, 400).astype(np.uint8), np.zeros(repeats.PAD, np.uint8)])
        at, sizes, docs = rng.integers(0, 300, 120), rng.integers(1, 40, 120), rng.integers(0, 9, 120)
        text = [raw[a : a + n].tobytes() for a, n in zip(at, sizes, strict=True)]
        order, lcp = repeats.suffix_order(raw, at, sizes)
        shared = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert [text[k] for k in order] == sorted(text)
        assert lcp.tolist() == [0, *(shared(text[a], text[b]) for a, b in zip(order[1:], order[:-1], strict=True))]
        need = rng.integers(1, 30, 120)
        want = [max((shared(text[k], text[j]) for j in range(120) if docs[j] < docs[k]), default=0) for k in order]
        got = repeats.previous_factors(lcp, docs[order], need[order])
        assert got.tolist() == [w if w >= n else 0 for w, n in zip(want, need[order].tolist(), strict=True)]


def test_toxicity(spark, docs, none):
    rng = random.Random(4)
    bad = ["idiot", "scum"]
    rows = [(k, " ".join(rng.choices(["one", "two", "three", "four", "five", "six"], k=30) + ([rng.choice(bad)] if k % 4 == 0 else []))) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(600)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.score(d, toxicity.train(d, labels)).withColumn("held", toxicity.held_out("row.doc_id")).where("held").collect()
    assert np.mean([(r.score >= 0.7) == (r.row.doc_id % 4 == 0) for r in got]) > 0.97
    model = toxicity.train(docs, labels.limit(0))
    assert toxicity.score(docs, model).count() == len(_rows()) and toxicity.score(none, model).count() == 0


def test_pieces(docs, none):
    own = pieces.loaded(open(pieces.MODEL, "rb").read())
    rng = random.Random(3)
    texts = [r[1] or "" for r in _rows()] + ["".join(rng.choices("abc ñ漢😀▁.\n\t09ThE", k=80)) for _ in range(100)] + ["x" * 3000, "    ", "▁", "\0"]
    ids = own.encode(texts)
    assert ids == own.library.encode(texts)
    assert [own.decode(i) for i in ids] == own.library.decode(ids)
    assert pieces.encode(docs).count() == len(_rows()) and pieces.encode(none).count() == 0
    text = np.frombuffer(b"banana$banana", np.uint8)
    assert pieces.suffix_array(text, 16).tolist() == sorted(range(13), key=lambda k: text[k:].tobytes())


def test_pieces_of_long_words(monkeypatch):
    """Runs without spaces, longer than a segment and cut at every place, against the library."""
    own = pieces.loaded(open(pieces.MODEL, "rb").read())
    rng = random.Random(6)
    monkeypatch.setattr(pieces, "TOGETHER", 2000)
    letters = "".join(rng.choices("thequickbrownfox", k=50_000))
    texts = [letters, "a" * 9000, "漢字かな交じり文を続ける" * 900, "".join(rng.choices("abcéñ漢字のを😀%#0a1\0", k=20_000)), f"so {'w' * 1023} {'v' * 1024} x", letters + " " + letters]
    ids = own.encode(texts)
    assert ids == own.library.encode(texts) and [own.decode(i) for i in ids] == texts
    assert max(map(len, own.words)) < pieces.LONG
    whole = "".join(rng.choices("漢字thequickbrownfox", k=5_000_000))
    monkeypatch.undo()
    assert own.encode([whole]) == own.library.encode([whole])


def test_surrogates(spark, docs, none):
    rows = [(1, "Mail Für.60@x.example.com FÜR.60@x.example.com +1 (017) 555-7713 4111 1111 1111 1111 10.2.3.4", "e"), (2, "Frau Anna Schmidt, Herr Karl Weber", "n"), (3, None, "n"), (4, "no 3.14 v1.2.3.4.5", "n"), (5, "für.60@x.example.com", "e")]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string, n_entities string"), "k").collect()}
    mails = re.findall(r"\S+@\S+", got[1].text) + [got[5].text]
    assert len({m.lower() for m in mails}) == 1 and "60@x" not in got[1].text and got[1].n_entities_1 == 5 and got[1].n_entities == "e"
    card = re.search(r"((?:\d{4} ){3}\d{4}) [\d.]+$", got[1].text)[1].replace(" ", "")
    assert sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(card)) % 10 == 0 and card != "4" + "1" * 15
    assert re.fullmatch(r"Frau \w+na \w+, Herr \w+n \w+", got[2].text) and got[3].text is None and got[4].text == rows[3][1]
    assert surrogates.replace(docs, "k").count() == len(_rows()) and surrogates.replace(none, "k").count() == 0
    many = spark.range(3000).select(F.lit("ssn").alias("kind"), F.format_string("%04d", F.col("id") % 600).alias("canonical"), F.lit("n").alias("gender"))
    made = surrogates.mapping(many, "k").collect()
    assert len(made) == 600 == len({r.surrogate for r in made}) and not {r.surrogate for r in made} & {r.canonical for r in made}


def test_surrogates_of_phone_and_card_layouts(spark):
    layouts = ["+491701234567", "+49 170 1234567", "+34 612 34 56 78", "06 12 34 56 78", "612 34 56 78", "+33 6 12 34 56 78", "5551234567", "01701234567", "+44 (0)20 79460123", "+1 (017) 555-7713", "3782 822463 10005", "378282246310005", "4111 1111 1111 1111"]
    rows = [(k, f"call {x}, now") for k, x in enumerate(layouts)] + [(50, "+49 170 1234567 4111 1111 1111 1111"), (51, "in 2024, 1700000000 or 3.1415926535 or 12 34 56")]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    for k, x in enumerate(layouts):
        assert got[k].n_entities == 1 and x not in got[k].text and re.sub(r"\d", "0", got[k].text) == re.sub(r"\d", "0", rows[k][1]), x
    squeezed = [re.sub(r"\D", "", got[k].text) for k in (0, 1)]
    assert squeezed[0] == squeezed[1] and got[50].n_entities == 2 and got[50].text.startswith(got[1].text[5:-5]) and got[51].n_entities == 0


def test_surrogates_keep_persons_together(spark):
    rows = [
        (1, "Herr Karl Weber kam. Karl Weber ging. Dr. Karl Weber blieb, und Weber schlief; KARL WEBER auch. Ein weber webt."),
        (2, "I met John Smith and Mr Smith. Mrs Anne-Marie O'Brien left; O'Brien's cat stayed. Prof. John A. Doe too."),
        (3, "Frau Dr. Anna von Berg, госпожа Анна Иванова. Smith is not known here."),
        (4, "Señora Andrea Weber. Mr Andrea Rossi."),
    ]
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string"), "k").collect()}
    m = re.fullmatch(r"Herr (\w+n) (\w+) kam. (\w+) (\w+) ging. Dr. (\w+) (\w+) blieb, und (\w+) schlief; (\w+) (\w+) auch. Ein weber webt.", got[1].text)
    karl, weber = m[1], m[2]
    assert [m[k] for k in range(3, 10)] == [karl, weber, karl, weber, weber, karl.upper(), weber.upper()] and got[1].n_entities == 6
    n = re.fullmatch(r"I met (\w+n) (\w+) and Mr (\w+). Mrs (\w+na) (\w+) left; (\w+)'s cat stayed. Prof. (\w+n) A. (\w+) too.", got[2].text)
    assert n[2] == n[3] and n[5] == n[6] and n[1] == n[7] and len({karl, weber, n[1], n[2], n[4], n[5], n[8]}) == 7
    o = re.fullmatch(r"Frau Dr. (\w+na) von (\w+), госпожа ([а-я]+на) ([а-я]+). Smith is not known here.", got[3].text.replace("А", "а").lower().replace("frau dr", "Frau Dr").replace("smith", "Smith"))
    assert o and got[3].n_entities == 2
    p = re.fullmatch(r"Señora (\w+) (\w+). Mr (\w+) (\w+).", got[4].text)
    assert p[2] == weber and p[1] == p[3] and p[4] not in (weber, p[1])
    with pytest.raises(ValueError):
        surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string"), "")


def test_surrogates_against_slots(spark):
    """Texts made of slots: equal entities in any spelling have equal surrogates, different ones different, the rest stays."""
    rng = random.Random(11)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    people = [f"{a}.{b}{k}@{c}.org" for k, (a, b, c) in enumerate((rng.choice(["ann", "bob"]), rng.choice(["lee", "kim"]), rng.choice(["mail", "post"])) for _ in range(60))]
    spell = {"email": lambda e: rng.choice([e, e.upper(), e.title()]), "phone": lambda e: f"+1 ({e[:3]}) {e[3:6]}{rng.choice('- .')}{e[6:]}", "ssn": lambda e: f"{e[:3]}-{e[3:5]}-{e[5:]}"}
    known = {"email": people, "phone": sorted({"2" + digits(9) for _ in range(60)}), "ssn": sorted({"1" + digits(8) for _ in range(60)})}
    rows, slots = [], []
    for k in range(150):
        own = [(kind := rng.choice(list(spell)), rng.choice(known[kind])) for _ in range(rng.randint(0, 6))]
        written = [spell[kind](e) for kind, e in own]
        rows.append((k, "start " + "".join(f"<{w}> then " for w in written) + "end"))
        slots.append(own)
    got = {r.doc_id: r for r in surrogates.replace(spark.createDataFrame(rows, "doc_id int, text string").repartition(4), "k").collect()}
    norm = {"email": str.lower, "phone": lambda x: re.sub(r"\D", "", x), "ssn": lambda x: re.sub(r"\D", "", x)}
    to = {}
    for k, own in enumerate(slots):
        parts = re.findall(r"<([^>]*)>", got[k].text)
        assert re.sub(r"<[^>]*>", "<>", got[k].text) == re.sub(r"<[^>]*>", "<>", rows[k][1]) and got[k].n_entities == len(own) == len(parts)
        for (kind, e), new, old in zip(own, parts, re.findall(r"<([^>]*)>", rows[k][1]), strict=True):
            assert to.setdefault((kind, e), norm[kind](new)) == norm[kind](new)
            assert re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", new))).rpartition(".")[0] == re.sub(r"[a-z]", "a", re.sub(r"[A-Z]", "A", re.sub(r"\d", "0", old))).rpartition(".")[0]
    for kind in spell:
        made = [v for (k, _), v in to.items() if k == kind]
        assert len(set(made)) == len(made) and not set(made) & set(known[kind])


def test_secrets(spark, docs, none):
    found, entries = secrets.scan(docs)
    got = {r.path: [(s.kind, s.start, s.end) for s in r.spans] for r in found.collect()}
    assert got[48] == [("assign", 0, 17), ("hex", 18, 42)] and got[42] == [] and found.count() == len(_rows())
    assert entries.count() == found.select("blob").distinct().count() * len(secrets.RULES)
    again, new = secrets.scan(docs, ledger=entries)
    assert new.count() == 0 and {r.path: len(r.spans) for r in again.collect()} == {k: len(v) for k, v in got.items()}
    newer = (*secrets.RULES[:-1], secrets.Rule("google", 2, secrets.RULES[-1].pattern))
    assert {r.rule for r in secrets.scan(docs, rules=newer, ledger=entries)[1].collect()} == {"google@2"}
    clean = {r.doc_id: r.text for r in secrets.redacted(docs).collect()}
    assert clean[48].startswith("[assign] [hex] mail") and clean[3] == _rows()[3][1]
    assert secrets.scan(none)[0].count() == 0


def test_order_minhash(docs, none):
    got = order_minhash.with_next(docs).collect()
    mark = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    rows = sorted(((i is not None, i or 0, mark(t or ""), t or "") for i, t, *_ in _rows()))
    want = Counter()
    for k, (*_, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][3]
        other = order_minhash.edited(t, following)
        a, b, c = (order_minhash.signature(x.encode()) for x in (t, other, following))
        want[(len(t), hashlib.sha256(other.encode()).hexdigest(), order_minhash.likeness(a, b), order_minhash.likeness(a, c))] += 1
    assert Counter((r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in got) == want
    assert order_minhash.with_next(none).count() == 0 and order_minhash.with_next(docs.limit(1)).count() == 1
    a, b = "abcdefghij" * 30, " ".join(f"w{k}" for k in range(300))
    sig = lambda x: order_minhash.signature(x.encode())
    moved = b[len(b) // 2 :] + b[: len(b) // 2]
    assert order_minhash.likeness(sig(b), sig(b)) == 1 and order_minhash.likeness(sig(b), sig(moved)) < 0.9 and order_minhash.likeness(sig(a), sig(b)) < 0.2


def test_html(spark):
    page = "<html><head><title>T</title></head><body><nav><ul><li><a href=x>Home</a></li></ul></nav><div class=ad>Buy</div><article><h1>Head &amp; tail</h1><p><b>One  two<br><p>Three\n four</p></article><footer>© 2024</footer></body></html>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", page), (1, "u", page)], "page_id long, url string, html string")
    got = html_blocks.extract(df).collect()
    assert sorted(r.text for r in got) == ["", "", *["Head & tail\nOne two\nThree four"] * 3] and html_blocks.extract(df.limit(0)).count() == 0
    rng, model, right, n = random.Random(12345), html_blocks.trained(), 0, 0
    for _ in range(100):
        text, y = html_blocks.layout(rng)
        x = html_blocks.features([(a, t.removeprefix("Α"), s) for a, t, s in html_blocks.blocks(text)])
        p = html_blocks.label([html_blocks._given(x, list(model))], list(model))[0]
        right, n = right + int(((p >= 0.5) == np.array(y)).sum()), n + len(y)
    assert right / n > 0.98


def test_html_keeps_text_of_all_but_scripts():
    for tag in ("svg", "math", "xmp", "object", "canvas", "template"):
        for end in (f"</{tag}>", ""):
            page = f"<article><p>before</p><div><{tag}>inside{end}</div><script>not()</script><style>nor</style><p>after</p></article>"
            assert [t for _, t, _ in html_blocks.blocks(page)] == ["before", "inside", "after"], page


def test_hnsw(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[0]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(2000, None), (2020, [0.0] * 16), (2040, [float("nan")] * 16), (2060, [1.0]), (2080, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df, lambda i: i % 20 == 0, shard=400).collect()
    hit = 0
    for q in range(0, 1500, 20):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in mine] == list(range(1, 21)) and all(abs(s[i] - v) < 1e-9 for _, i, v in mine)
        hit += len({i for _, i, _ in mine} & set(np.lexsort((np.arange(1500), -s))[:20].tolist()))
    assert hit / (75 * 20) >= 0.9 and not {r.query_id for r in got} & {2000, 2020, 2040, 2080}
    assert hnsw.nearest(df.limit(0), lambda i: i % 20 == 0).count() == 0


def test_hnsw_repeated_rows(spark):
    rows = [(k, [1.0, 2.0, 0.5]) for k in range(40) for _ in range(3)] + [(100, [0.1, 0.1, 0.1])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), lambda i: i == 0).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(k, k) for k in range(1, 21)]
    rows = [(0, [1.0, 2.0])] * 30 + [(k, [1.0, 2.0]) for k in range(1, 6)] + [(k, [0.5, 0.1 * k]) for k in range(6, 30)]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), lambda i: i == 0).collect()
    want = sorted(((-(x + 2 * y), i) for i, (x, y) in set((i, tuple(v)) for i, v in rows) if i))[:20]
    assert [(i, -s) for s, i in want] == [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])]


@pytest.mark.parametrize("scale", [1.0, 1e-60, 1e60])
def test_hnsw_doubles_in_clusters(spark, scale):
    """Whole double precision, several shards, another column named like an own one, an id that has two vectors."""
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(30, 12))[rng.integers(0, 30, 1200)] + rng.normal(size=(1200, 12)) * 0.05) * scale
    rows = [(k, v.tolist(), "s") for k, v in enumerate(x)] + [(20, (x[21] * 1.01).tolist(), "s")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard string").repartition(5)
    got = hnsw.nearest(df, lambda i: i % 20 == 0, k=10, shard=300).collect()
    assert df.count() == 1201 and len(got) == 61 * 10
    hit = 0
    for q in range(40, 1200, 20):
        s = np.append(x @ x[q], x[20] * 0 @ x[q] + (x[21] * 1.01) @ x[q])
        ids = np.append(np.arange(1200), 20)
        s[q] = -np.inf
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        hit += sum(abs(a / b - 1) < 1e-12 for (_, _, a), b in zip(mine, np.sort(s)[::-1], strict=False))
        assert all(any(abs(v / t - 1) < 1e-12 for t in s[ids == i]) for _, i, v in mine)
    assert hit / (58 * 10) >= 0.95


def test_pipeline_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        if name != "pieces":
            assert now.columns == docs.columns
    assert now.count() > 0 and set(now.columns) == {*docs.columns, "n_tokens", "ids"}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pieces_keep_pairs_between_tasks(monkeypatch):
    """What a task learns of pairs is known to the next, and pairs that share a slot keep their own answers."""
    monkeypatch.setattr(pieces, "SLOTS", 8)
    own = pieces.Pieces(Path(pieces.MODEL).read_bytes())
    texts = ["the sum of all terms below it, déjà vu", "漢字 and \U0001f600 in antidisestablishmentarianism", "Zq0xQ" * 40, "", "  a  b"]
    want = own.library.encode(texts)
    assert own.encode(texts) == want
    own.forget()
    known = len(own.pairs)
    asked = []
    monkeypatch.setattr(own, "_apart", lambda *a: asked.append(a))
    assert known and own.encode(texts) == want and not asked


def test_simhash_stage_links_by_fingerprints(spark, monkeypatch):
    """Fingerprints find the near copies in the pipeline's stage that are then confirmed."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "x"]), " ".join(f"v{k}" for k in range(300)), "a b", None]
    seen = []
    monkeypatch.setattr(simhash, "near_links", lambda prints, f=simhash.near_links: seen.append(prints.count()) or f(prints))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()) == [0, 2, 3, 4] and len(seen) == 1
    rows = [(k, simhash.fingerprint(t)) for k, t in enumerate(texts)]
    alike = shingles._of_fingerprints(spark.createDataFrame(rows, "key long, fp long")).collect()
    assert (0, 1) in {(r.a, r.b) for r in alike} and (0, 2) not in {(r.a, r.b) for r in alike}


def test_simhash_stage_closes_links_twice(spark, monkeypatch):
    """Pairs of fingerprints and of bands are confirmed and closed together; each closure is many rounds of small tasks, in which an executor's memory grows."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base), " ".join([*base[:399], "x"]), " ".join([*base[:398], "y", "z"]), " ".join(f"v{k}" for k in range(300))]
    closed = []
    for module in (shingles, simhash):
        monkeypatch.setattr(module, "connected_components", lambda *a, f=shingles.connected_components: closed.append(a) or f(*a))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, df, "").collect()) == [0, 3] and len(closed) == 2
