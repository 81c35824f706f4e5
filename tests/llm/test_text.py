import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gridloom.llm import decontaminate, langid, packing, pii, quality_rules, toxicity

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


HARD = ["", " ", "a", "  two  blanks ", "tab\t and\n\n new lines \n", "don't we'll I'M 12 34x", "naïve café — ünï", "a" * 300, "<|endoftext|> x", "x  \n  y", "日本語 テキスト", "é ​ z", " lead", "trail ", " nbsp  em"]


def test_ids_are_the_library_s(library, rows):
    c = packing.coder(PATH)
    assert c.plain
    for t in [*HARD, *(t for _, t in rows if t)]:
        assert np.frombuffer(c.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_ids_of_white_space_runs(library):
    """Blanks beside every other white space, where a blank may or may not begin a word."""
    c, r = packing.coder(PATH), random.Random(3)
    white = [chr(i) for i in range(0x3100) if chr(i).isspace()]
    other = ["word", "the", "10", "'s", "é", "中", "!", "...", "$", "x", "\u200b", "\u180e"]
    texts = ["word \xa0 \xa0 word", "x \xa0 \xa0\n", "Price: \xa0 \xa0 10", "x\xa0 ", "x "]
    texts += ["".join(r.choice(white if r.random() < 0.3 else [" "] if r.random() < 0.4 else other) for _ in range(r.randint(1, 10))) for _ in range(20000)]
    for t, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(c.encode(t), "<u4").tolist() == e.ids, t


def test_pack_round_trip(spark, library, docs, rows, empty):
    texts = {d: t or "" for d, t in rows}
    long = 1000
    texts[long] = "word " * 9000
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(long, texts[long])], "doc_id bigint, text string"))
    out = packing.pack(df, PATH).toPandas()
    for d, g in out.sort_values("start").groupby("doc_id"):
        ids = np.array([*library.encode(texts[d], add_special_tokens=False).ids, 1], "<u4")
        assert g["start"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        assert g["length"].sum() == len(ids) and set(g["doc_tokens"]) == {len(ids)}
        for r in g.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert set(out["doc_id"]) == set(texts)
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
    assert packing.pack(empty, PATH).collect() == []


def test_cuts_are_optimal():
    """Against a plain dynamic programme over all earlier cuts."""
    r = np.random.default_rng(3)
    for _ in range(20):
        at = np.unique(np.concatenate([[0], r.integers(1, 400, 60)])).tolist()
        at = [0] + [x for x in range(1, 400) if x in at or x % 16 == 0]
        penalty = [0] + r.integers(0, 9, len(at) - 1).tolist()

        def cost(n, length=32):
            return 0 if n & (n - 1) == 0 else length - n

        best = [0] + [10**9] * (len(at) - 1)
        for j in range(1, len(at)):
            best[j] = min(best[i] + cost(at[j] - at[i]) for i in range(j) if at[j] - at[i] <= 32) + penalty[j] + packing.WINDOW_COST
        cuts = packing.best_cuts(at, penalty, 32)
        place = {x: i for i, x in enumerate(at)}
        got = sum(cost(b - a) + penalty[place[b]] + packing.WINDOW_COST for a, b in zip([0, *cuts], cuts, strict=False))
        assert cuts[-1] == at[-1] and got == best[-1]


ITEMS = [(1, "alpha beta gamma delta"), (2, " ".join(f"w{i}" for i in range(20))), (3, None), (4, "?!"), (5, " ".join(f"w{i}" for i in range(3, 16))), (None, "one two"), (2, "Alpha-Beta gamma DELTA")]
TEXTS = [(0, "x Alpha, BETA gamma delta! y"), (1, "pre " + " ".join(f"W{i}" for i in range(1, 17)) + " post"), (2, None), (3, ""), (4, "alpha beta gamma"), (5, "é alpha beta gamma delta alpha beta gamma delta"), (6, "alphabeta gamma delta")]


@pytest.mark.parametrize("max_bytes", [decontaminate.MAX_BENCHMARK_BYTES, 40])
def test_decontaminate_is_brute_force(spark, max_bytes):
    docs = spark.createDataFrame([(*t, 1, "z") for t in TEXTS], "doc_id bigint, text string, n_hit int, items string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = {r["doc_id"]: r for r in decontaminate.decontaminate(docs, bench, max_bytes=max_bytes).collect()}
    want = decontaminate.brute_force(TEXTS, [(i, t) for i, t in ITEMS if i is not None])
    assert {k: (r["n_words"], r["n_hit"], list(r["items"])) for k, r in got.items()} == want
    text = dict(TEXTS)
    assert [text[0][s["lo"] : s["hi"]] for s in got[0]["spans"]] == ["Alpha, BETA gamma delta"]
    assert got[5]["contaminated"] and not got[2]["contaminated"] and not got[3]["contaminated"]
    none = bench.filter("item_id = 99")
    assert not any(r["contaminated"] for r in decontaminate.decontaminate(docs, none).collect())


@pytest.mark.parametrize("max_bytes", [decontaminate.MAX_BENCHMARK_BYTES, 200])
def test_decontaminate_rows_and_windows(spark, empty, max_bytes):
    """Repeated and null keys keep a result a row; random words with shared passages against comparing every window."""
    import random

    r = random.Random(8)
    words = [f"w{i}" for i in range(6)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([40, 13, 14, 20, 12, 5, 27, 1, 33])] + [(50, " ".join(["a"] * 30)), (51, "x " * 13)]
    texts = [" ".join(r.choices(words, k=200)) for _ in range(3)]
    for _, t in items:
        w = t.split()
        for _ in range(4):
            lo = r.randrange(max(1, len(w) - 12))
            texts.append(f"pré {' '.join(r.choices(words, k=3))}, {' '.join(w[lo : lo + r.randint(10, 30)]).upper()} {' '.join(r.choices(words, k=4))}")
    texts += ["a " * 12, "a " * 13, "a " * 50 + "é", "x " * 26]
    docs = [*enumerate(texts)] + [(5, texts[9]), (None, texts[10]), (None, texts[4]), (None, None)]
    got = decontaminate.decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), max_bytes=max_bytes).collect()
    want = decontaminate.brute_force([*enumerate(t for _, t in docs)], items)
    as_rows = lambda rows: sorted(rows, key=repr)
    assert as_rows((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in got) == as_rows((docs[i][0], *v) for i, v in want.items())
    assert sum(v[1] > 0 for v in want.values()) > 20
    assert decontaminate.decontaminate(empty, spark.createDataFrame(items, "item_id bigint, text string"), max_bytes=max_bytes).collect() == []


def test_pii_base_patterns():
    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii._luhn(re.sub("[^0-9]", "", m[0]))]
        return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]

    for t in ["a@b.c@d.e", "@b.c@d.e x@y", "a@b a@b.c. a@b.c.d", "1.2.3.4.5.6.7.8 256.1.1.1 001.2.3.4", "4111 1111-1111 1111 x 4111111111111112", "+1 (234) 555-1234 +12 +123456789012345678", "4111111111111111 4111111111111111", "+1.2.3.4.5.6.7.8-", "é 12.13.14.15 ü", "+1 2+3 4567890 1", "..a@b-.-c"]:
        assert pii.base_spans(t) == plain(t), t
    assert pii.base_spans("1" * 100_000 + "." * 1000) == [] and pii.base_spans("a" * 200_000) == []


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("mail john.doe [at] example [dot] com now", "email", "john.doe [at] example [dot] com"),
        ("write to jane at mail dot example dot org please", "email", "jane at mail dot example dot org"),
        ("call plus four nine one five one two three four five six seven.", "phone", "plus four nine one five one two three four five six seven"),
        ("card four " + "one " * 15 + "ok", "card", "four " + " ".join(["one"] * 15)),
        ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("host １９２.168.1.1 up", "ip", "１９２.168.1.1"),
        ("a​b@c​d.com", "email", "a​b@c​d.com"),
        ("jоhn@example.com", "email", "jоhn@example.com"),
    ],
)
def test_pii_disguises(text, kind, found):
    base, more = pii.find(text)
    spans = [(k, text[a:b]) for k, a, b in [*base, *more]]
    assert (kind, found) in spans or (text.startswith("jо") and ("email", "hn@example.com") in spans)
    assert f"[{kind.upper()}]" in pii.mask(text, [*base, *more])


def test_pii_added_spans_overlap_no_base_span():
    """Against comparing each with every base span."""
    import random

    r = random.Random(6)
    parts = ["a@b.co ", "x [at] y [dot] com ", "1.2.3.4 ", "one two.one.two.three ", "+1 234 567 8901 ", "+four nine one five one 234 567 ", "4111 1111 1111 1111 ", "j\u043e@e.com", " the dot "]
    for _ in range(300):
        t = "".join(r.choices(parts, k=r.randint(1, 12)))
        base, more = pii.find(t)
        norm, pieces = pii.normalise(t)
        every = [(k, *pii._source(pieces, len(norm), a, b)) for k, a, b in pii.base_spans(norm)]
        assert more == [(k, a, b) for k, a, b in every if all(b <= x or y <= a for _, x, y in base)]


def test_pii_leaves_clean_text():
    for t in ("meet me at example.com dot", "one two three dogs at home", "the dot at the end", "Punkt at Berlin. eins zwei", ""):
        assert pii.find(t) == ([], [])


@pytest.mark.parametrize(
    "text,kind,found",
    [
        ("to john{at}example.com now", "email", "john{at}example.com"),
        ("john <at> example.com", "email", "john <at> example.com"),
        ("john [ at ] example.com", "email", "john [ at ] example.com"),
        ("a@b{.}com", "email", "a@b{.}com"),
        ("one nine two.one six eight.one zero.two five", "ip", "one nine two.one six eight.one zero.two five"),
        ("+49 one five one 234 567", "phone", "+49 one five one 234 567"),
        ("4111 1111 one one one one one one one one", "card", "4111 1111 one one one one one one one one"),
        ("+ONE ſIX fıve 555 1234", "phone", "+ONE ſIX fıve 555 1234"),
    ],
)
def test_pii_short_disguises(text, kind, found):
    """Disguises without the word dot and with few spelled digits, alone and beside that word."""
    for t in (text, text + " the dot at the end"):
        base, more = pii.find(t)
        assert [(k, t[a:b]) for k, a, b in more] == [(kind, found)], (t, base)


def test_pii_gate_agrees_with_the_rules():
    """Whatever the transducers change passes the gate before them."""
    import random

    r = random.Random(2)
    parts = [*"[](){}<> \t,-.@x4é\u00a0\u200b", "at", "AT", "dot", "Dot", "plus", "one", "TWO", "zero", "ſix", "fıve", "NİNE", "oh", "ａｔ"]
    changed = 0
    for _ in range(20_000):
        t = "".join(r.choices(parts, k=r.randint(1, 9)))
        if pii.normalise(t)[0] != t:
            changed += 1
            assert pii._disguised(t), t
    assert changed > 5000


def test_pii_rows(spark, docs, rows, empty):
    got = {r["doc_id"]: r["spans"] for r in pii.detect(docs.withColumn("text", F.concat("text", F.lit(" a@b.co")))).collect()}
    assert got[38] == [] and all(len(v) == 1 for k, v in got.items() if k != 38)
    masked = {r["doc_id"]: r["text"] for r in pii.mask_documents(docs.withColumn("text", F.concat("text", F.lit(" a@b.co")))).collect()}
    assert masked == {d: None if t is None else t + " [EMAIL]" for d, t in rows}
    assert pii.detect(empty).collect() == [] and pii.mask_documents(empty).collect() == []


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_quality_base_counts(spark, docs, rows, empty):
    extra = [(900, ("a b c d e f g h i " * 9) + "# $ |\n\nx\nx\n x\r\nx"), (901, "w " * 30), (902, "\x0b\x0c \r\n"), (903, "é ü " * 25)]
    df = docs.select("doc_id", "text", "source", "n_words").union(spark.createDataFrame([(d, t, None, 1) for d, t in extra], "doc_id bigint, text string, source string, n_words int"))
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(df).collect()}
    for d, t in [*rows, *extra]:
        t, w = t or "", words_of(t)
        at: dict = {}
        for i in range(len(w) - 7):
            at.setdefault(tuple(w[i : i + 8]), []).append(i)
        hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in t.split("\n") if words_of(x)]
        r = got[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)), d
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w))
    assert quality_rules.quality_rules(empty).collect() == []


def _line_docs(spark):
    """One host: 60 documents share a line; five of them are little else; ten copies of one document must stay."""
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    common = " ".join(f"boiler{k}" for k in range(25))
    rows = [(i, f"{own(i, 40)}\n {common.upper()} ", "a") for i in range(55)] + [(i, f"{common}\n{own(i, 5)}", "a") for i in range(55, 60)]
    rows += [(i, own(1000, 50) + "\n" + own(1001, 50), "a") for i in range(60, 90)] + [(90, f"{own(90, 5)}\n{common}", "b")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string")


def test_quality_line_frequency(spark):
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(_line_docs(spark)).collect()}
    assert [d for d, r in got.items() if not r["kept"]] and sorted(d for d, r in got.items() if not r["kept"]) == [55, 56, 57, 58, 59]
    assert got[0]["n_line_words"] == 25 and got[70]["n_line_words"] == 0 and got[90]["n_line_words"] == 0
    clean = {r["doc_id"]: r["text"] for r in quality_rules.pipeline_stage(_line_docs(spark)).collect()}
    assert set(clean) == {*range(55), *range(60, 91)}
    assert clean[3] == " ".join(f"d3w{k}" for k in range(40)) and "boiler0" in clean[90]


def test_quality_line_of_least_digest(spark):
    """A shared line counts the documents that hold it, also where its own hash is the least of every document; near copies count once."""
    own = lambda i, n: " ".join(f"d{i}w{k}" for k in range(n))
    common = "least of all"
    digest = lambda x: hashlib.md5(x.encode()).hexdigest()
    lines = [x for x in (own(i, 40) for i in range(400)) if digest(x) > digest(common)][:40]
    assert len(lines) == 40
    near = own(1000, 200).split(" ")
    rows = [(i, f"{x}\n{common}", "a") for i, x in enumerate(lines)] + [(100 + i, "\n".join([own(1000, 200), " ".join([*near[:100], f"x{i}", *near[101:]]), "of copies"]), "b") for i in range(60)]
    rows += [(200 + i, f"{own(500, 60)}\nof copies", "b") for i in range(30)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert {got[i]["n_line_words"] for i in range(40)} == {3}
    assert {r["n_line_words"] for d, r in got.items() if d >= 100} == {0}


def test_language_prediction(spark, empty):
    import random

    bits = {"en": ["the", "ing", "tion", "wh", "ou"], "de": ["sch", "ung", "ei", "ß", "ver"], "fr": ["eau", "oi", "que", "é", "ç"]}

    def make(lang, seed):
        r = random.Random(f"{lang}{seed}")
        return " ".join("".join(r.choices(bits[lang], k=r.randint(1, 3))) for _ in range(60))

    rows = [(i, make(k, i), k) for i, k in enumerate(["en", "de", "fr"] * 60)]
    df = spark.createDataFrame([*rows, (1000, None, "en"), (1001, "12 !! 34", "en"), (1002, "", None)], "doc_id bigint, text string, lang string")
    train = df.filter(~langid.held_out(F.col("doc_id")))
    got = {r["doc_id"]: r for r in langid.predict(df, langid.fit(train)).collect()}
    want = {d: k for d, _, k in rows}
    assert np.mean([got[d]["lang_pred"] == k for d, k in want.items()]) > 0.97
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (1000, 1001, 1002))
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.predict(df, langid.fit(empty)).collect()} == {"und"}
    held = {r[0]: r[1] for r in df.select("doc_id", langid.held_out(F.col("doc_id"))).collect()}
    assert held == {d: zlib.crc32(str(d).encode()) % 3 == 1 for d in held}


def test_language_of_texts_without_letters_and_share_of_large_languages(spark):
    assert [langid.has_letter(t) for t in ("", "12 _ \u0301", "½ ② ² Ⅷ ٣", "½a", "ª", "語", "Ⅷ É")] == [False, False, False, True, True, True, True]
    model = langid.Model({"en": b"the words of a language", "de": b"die woerter einer sprache"})
    assert model.predict("½ ² Ⅷ") == ("und", 0.0, True) and model.predict("words of the language")[0] == "en"
    df = spark.range(4000).selectExpr("id AS doc_id", "'text of a language' AS text", "'en' AS lang")
    assert 5 <= langid.fit(df, sample_docs=20)["en"].count(b"text of") <= 45


def test_toxicity(spark, empty, make_prose):
    import random

    def make(i):
        toxic = i % 3 == 0
        words = make_prose(i, 80).split(" ")
        r = random.Random(i)
        for _ in range(r.randint(2, 8) if toxic else 0):
            words[r.randrange(80)] = r.choice(["scum", "idiot", "trash", "moron"]) + r.choice(["", "!", ","])
        return i, " ".join(words), int(toxic)

    rows = [make(i) for i in range(300)]
    docs = spark.createDataFrame([(i, t, 1) for i, t, _ in rows] + [(999, None, 1), (998, "", 1)], "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows[:200]] + [(0, 0), (None, 1), (999, None)], "doc_id bigint, toxic int")
    weights, theta = toxicity.fit(docs, labels)
    assert theta == sorted(theta) and len(theta) == 2
    got = {r["doc_id"]: r for r in toxicity.score(docs, weights, theta).collect()}
    assert np.mean([got[i]["toxic"] == bool(y) for i, _, y in rows[200:]]) > 0.97
    assert not got[999]["toxic"] and not got[998]["toxic"]
    assert toxicity.fit(docs, labels.filter("toxic = 0")) == ({}, []) and toxicity.fit(empty, labels) == ({}, [])


def test_toxicity_grades_are_the_labels(spark, make_prose):
    """Documents labelled toxic and of good quality are the upper grade; repeated labels that differ are none."""
    bad = ["", "scum idiot", "scum idiot vile slayer"]
    rows = [(i, f"{make_prose(i, 40)} {bad[i % 3]}") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 3 != 1)) for i, _ in rows[:150]] + [(0, 1, 1), (1, 1, None)], "doc_id bigint, toxic int, quality int")
    weights, theta = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, weights, theta).collect()}
    assert np.mean([got[i]["grade"] == i % 3 for i in range(150, 240)]) > 0.97
    assert len({round(r["severity"], 6) for r in toxicity.score(docs.limit(1).unionAll(docs.limit(1)), weights, theta).collect()}) == 1


def test_ordinal_fit_recovers_order():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 3))
    z = x @ [1.5, -1.0, 0.0] + r.logistic(size=3000)
    w, theta = toxicity.fit_ordinal(x, np.digitize(z, [-1.0, 1.0]))
    assert theta[0] < theta[1] and w[0] > 0.8 and w[1] < -0.5 and abs(w[2]) < 0.2
