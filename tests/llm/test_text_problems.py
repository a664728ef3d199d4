"""Small tests of the text operators against brute force and defined cases."""

import random
import unicodedata
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from manualake.llm.bilingual import Bitext, Translations, align, align_texts, compact, retrieved, tokens
from manualake.llm.canonical import Vocabulary, canonical, hash64, look_alike_pairs, skeleton, table_form
from manualake.llm.encoding import TOKENIZER, TreeDecoder, TreeEncoder, _model, decode, encode
from manualake.llm.language_id import SEGMENTS, LanguageModel, fit_language_model, language_segments, sentences, wrong_labels
from manualake.llm.leakage import FMIndex, leaked_passages
from manualake.llm.near_duplicates import SetSketch, Shingler, classes_with_links, expand, near_duplicates
from manualake.llm.scan_noise import Bloom, Layout, ScanNoise, anagram_hash, bloom, brand_words, turns_into
from manualake.llm.shared_spans import shared_share, shared_spans, sliding_min

WORDS = "water filter pump valve drain hose grinder motor brew chamber seal ring front cover rear panel clean replace tighten check open close".split()


def sentence(rng, n=12):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + f" {rng.randrange(10**6)}."


# 6: look-alikes


@pytest.mark.parametrize(
    ("odd", "plain"),
    [("Ｗａｔｅｒ", "Water"), ("wаtеr", "water"), ("wa​ter⁠", "water"), ("état", "état"), ("ﬁlter", "filter"), ("a b", "a b"), ("a‑b", "a-b"), ("a–b", "a–b"), ("", ""), ("x²", "x²")],
)
def test_forms(odd, plain):
    assert table_form(odd) == plain
    assert Vocabulary([("water", 3), ("filter", 2)]).form(odd) == plain


@given(st.text(max_size=40))
def test_forms_are_stable(text):
    form = table_form(text)
    assert table_form(form) == form
    assert Vocabulary([]).form(text) == table_form(text) or unicodedata.normalize("NFC", Vocabulary([]).form(text)) == form


def test_trie_prefers_frequent_words_and_edits_within_budget():
    v = Vocabulary([("Ilse", 1), ("lIse", 5)])
    assert v.form("Ӏlse") == "Ilse"
    assert Vocabulary([("filter", 9)], budget=1).spelling("fiІter") == "filter"
    assert Vocabulary([("filter", 9)]).spelling("fiХter") == "fiXter"


def test_look_alike_pairs(spark):
    rows = [("t", "1", "water"), ("t", "2", "wаter"), ("t", "2", "wаter"), ("t", "3", "water"), ("u", "4", "wаter"), ("t", "5", ""), ("t", "6", "​"), ("t", "7", "Water")]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string")
    for bound in (1, 2_000):
        got = sorted(tuple(r) for r in look_alike_pairs(df, group_rows=bound).collect())
        assert got == [("t", "1", "2"), ("t", "2", "3"), ("t", "5", "6")]
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_letters_of_two_readings_follow_the_words_of_the_corpus(spark):
    rows = [("t", "1", "(fiӏter) it"), ("t", "2", "once: filter, filter filter."), ("t", "3", "ӏӀ"), ("t", "4", "Ӏlse"), ("t", "5", "Ilse\u3000Ilse"), ("t", "6", "fiӀter, fiІter, oӀive"), ("t", "7", "fiIter, olive"), ("t", "8", "")]
    rows += [("u", str(i), f"other{i} words{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string")
    got = {r.rec_id: r.form for r in canonical(df.filter("src = 't'").unionAll(df.filter("src = 'u'"))).filter("src = 't'").collect()}
    assert got == {"1": "(filter) it", "2": "once: filter, filter filter.", "3": "lI", "4": "Ilse", "5": "Ilse Ilse", "6": "filter, fiIter, olive", "7": "fiIter, olive", "8": ""}
    assert skeleton("fiӀter") == skeleton("filter") == skeleton("fiIter")


def test_hash_equals_sparks(spark):
    words = ["", "a", "straße", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] for r in got] == [hash64(w) for w in words]


# 5: near-duplicates


def brute(texts, size, threshold):
    sh = Shingler(size)
    sets = {i: set(sh.shingles(sh.word_hashes(t)).tolist()) for i, t in texts.items() if t}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def test_near_duplicates_against_brute_force(spark):
    rng = random.Random(3)
    texts = {i: " ".join(sentence(rng) for _ in range(6)) for i in range(40)}
    for i in range(40, 70):
        ws = texts[i - 40].split()
        ws[rng.randrange(len(ws))] = "edited"
        texts[i] = " ".join(ws)
    texts |= {100: texts[0], 101: texts[0].upper(), 102: "", 103: "two words", 104: "two words", 105: "x " * 20_000}
    rows = [(i, None, t, 1) for i, t in texts.items()] + [(0, None, texts[0], 1), (200, "head", None, 1), (None, None, texts[1], 1)]
    df = spark.createDataFrame(rows, "id long, head string, text string, key int")
    pairs, members = near_duplicates(df, shingle=3, threshold=0.6)
    got = {(r.a, r.b) for r in expand(pairs, members).collect()}
    assert got == brute(texts, 3, 0.6)
    rows = classes_with_links(pairs, members).collect()
    assert len(rows) == len({r.id for r in rows}) == sum(1 for t in texts.values() if t)
    pairs, members = near_duplicates(df.limit(0))
    assert expand(pairs, members).count() == 0


def test_sketch_merges_and_estimates():
    rng = np.random.default_rng(5)
    sketch = SetSketch(512)
    for share in (0.2, 0.6, 0.9):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (int(1000 * share), int(1000 * (1 - share)) // 2, int(1000 * (1 - share)) // 2))
        x, y = np.concatenate([common, a]), np.concatenate([common, b])
        kx, ky, kxy = sketch.registers([x, y, np.concatenate([x, b])])
        assert (SetSketch.merge(kx, ky) == kxy).all()
        true = len(common) / (len(common) + len(a) + len(b))
        assert abs(sketch.jaccard(kx[None], ky[None], np.array([len(x)]), np.array([len(y)]))[0] - true) < 0.1


# 8: encoding

ENCODER = TreeEncoder(_model(TOKENIZER), leaf=2, window=1)


@settings(deadline=None, max_examples=150)
@given(st.lists(st.sampled_from(["'", "l", "ll", "e", "s", " ", "  ", "\n", "é", "é", "5", "½", "水", "🔧", "　", ".", "<|endoftext|>", "'ve", "\xa0", "_"]), max_size=40).map("".join))
def test_tree_equals_whole(text):
    want = ENCODER.tokenizer.encode(text, add_special_tokens=False).ids
    assert (ENCODER.tree(text, 0, len(text)).ids if text else []) == want
    assert DECODER.decode(want) == text


DECODER = TreeDecoder(_model(TOKENIZER))


def test_encode_nulls_empty_and_long(spark):
    texts = [None, "", " ", "water filter " * 5_000, "<|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode(df).collect()}
    assert got[0] == got[1] == []
    assert got[3] == ENCODER.tokenizer.encode(texts[3], add_special_tokens=False).ids
    assert {r.doc_id: r.text for r in decode(encode(df)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert encode(df.limit(0)).count() == 0


# 9: leakage


def test_fm_index():
    rng = np.random.default_rng(1)
    text = rng.integers(1, 4, 300)
    index = FMIndex(text, 3, sample=5)
    phrases = rng.integers(1, 4, (50, 4))
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi):
        want = [i for i in range(len(text) - 3) if (text[i : i + 4] == p).all()]
        assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def test_leaks(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, f"x {item.upper().replace(' ', ', ')} y"), (2, " ".join(item.split()[:11])), (3, None), (4, ""), (5, " ".join(item.split()[1:]) + " z " + item), (5, " ".join(item.split()[1:]) + " z " + item)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame([(7, item), (8, "short"), (9, None), (7, item)], "item_id long, text string")
    for kw in ({}, {"shard_words": 5}, {"block_chars": 10}):
        got = leaked_passages(d, i, **kw)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 7), (5, 7)}
    spans = {(r.span_start, r.span_chars) for r in got.filter("doc_id = 5").collect()}
    tail = " ".join(item.split()[1:])
    assert spans == {(0, len(tail)), (len(tail) + 3, len(item))}
    assert leaked_passages(d, i.limit(0)).count() == leaked_passages(d.limit(0), i).count() == 0


# 10: shared spans


def brute_spans(texts, size):
    seen = defaultdict(set)
    for i, t in texts.items():
        for p in range(len(t or "") - size + 1):
            seen[t[p : p + size]].add(i)
    out = set()
    for i, t in texts.items():
        covered = sorted(p for p in range(len(t or "") - size + 1) if len(seen[t[p : p + size]]) > 1)
        start = None
        for k, p in enumerate(covered):
            start = p if start is None else start
            if k + 1 == len(covered) or covered[k + 1] > p + size:
                out.add((i, start, p + size - start))
                start = None
    return out


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(9)
    passages = ["".join(rng.choice("abcdé🔧 ") for _ in range(n)) for n in (20, 25, 19, 60)]
    texts = {}
    for i in range(30):
        texts[i] = "".join(rng.choice([*passages, "".join(rng.choice("xyzü") for _ in range(rng.randrange(30)))]) for _ in range(4))
    texts |= {50: texts[0], 51: "", 52: None, 53: "q" * 5_000, 54: passages[3] * 2}
    df = spark.createDataFrame([*texts.items(), (0, texts[0])], "doc_id long, text string")
    got = {tuple(r) for r in shared_spans(df, span=20, gram=6).collect()}
    assert got == brute_spans(texts, 20)
    share = {r.doc_id: r.shared_chars for r in shared_share(shared_spans(df, span=20, gram=6), df).collect()}
    assert share[50] == sum(n for i, _, n in got if i == 50) and share[53] == 0
    assert shared_spans(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shared_spans(df, span=20, gram=11)


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 100, 53)
    for k in (1, 5, 53, 60):
        assert sliding_min(x, k).tolist() == [x[i : i + k].min() for i in range(len(x) - k + 1)]


# 1: scan noise


def test_confusions():
    assert turns_into("filter", "filtcr", 1) and turns_into("hinge", "liiri9e", 3) and not turns_into("hinge", "liiri9e", 2) and turns_into("modem", "rnoclem", 2)
    assert anagram_hash("filter") - anagram_hash("e") + anagram_hash("c") == anagram_hash("filtcr")


def test_scan_noise(spark):
    rng = random.Random(4)
    clean = [(i, f"Clean the water filter with care. The {rng.choice(WORDS)} and door- or panel screws stay dry after {i} cycles.") for i in range(120)]
    noisy = {
        900: "Clean the wa-\nter filter with care.",
        901: "Clean the water filtcr with c@re.",
        902: "Clean the water filter\nService manual – rev. C\nwith care.",
        903: "Clean the water filter\n- 12 -\nwith care.",
        904: "The door-\nor panel screws stay dry.",
        905: "1. Clean the water filter.\n2. The panel stays dry.",
        906: "Clean the water fil-\nOrvo HPT | Service manual | Page 3 of 9\nter with c@re.",
        907: "",
        908: None,
    }
    heads = [(700 + i, f"Clean the\nService manual {b}\nwater filter with care.") for i, b in enumerate(("Orvo HPT", "– rev. A", "– rev. B", "Orvo ABC"))]
    rows = [("topic_text", str(i), t) for i, t in [*clean, *heads, *noisy.items(), (900, noisy[900])]]
    df = spark.createDataFrame(rows, "src string, rec_id string, text string").filter("text is not null")
    product = spark.createDataFrame([("Orvo",), (None,)], "brand_name string")
    want = {900: {"hyphen"}, 901: {"misread"}, 902: {"header"}, 903: {"page"}, 906: {"hyphen", "header", "page", "misread"}} | {i: {"header"} for i, _ in heads}
    for bound in (100_000, 0):  # headers sent to all rows, or joined to those that hold them
        noise = ScanNoise(df, product, header_bound=bound)
        got = defaultdict(set)
        for r in noise.damage().collect():
            got[int(r.rec_id)].add(r.defect)
        assert dict(got) == want
        fixed = {int(r.rec_id): r.text for r in noise.repaired().collect()}
    assert fixed[900] == fixed[901] == fixed[902] == fixed[903] == fixed[906] == "Clean the water filter with care."
    assert fixed[904] == "The door- or panel screws stay dry." and fixed[905] == noisy[905] and fixed[907] == ""
    empty = ScanNoise(df.limit(0), product.limit(0))
    assert empty.damage().count() == 0


def test_long_and_rare_headers_and_long_words(spark):
    head = "Bedienungsanleitung der vollautomatischen Kaffeemaschine mit Mahlwerk und Milchsystem sowie Zubehör und Teilekunde in einem Band"
    assert len(head) > 95 and len(head.split()) >= 14
    word = "entkalkungs" * 12 + "programm"
    rows = [(f"a{i}", f"Clean the pump {i}\nbefore the valve {i} opens") for i in range(400)] + [(f"h{i}", f"Clean the\n{head}\nfilter {i} today") for i in range(3)]
    rows += [(f"w{i}", f"Start the {word} now") for i in range(60)] + [("m", f"Start the {word.replace('mm', 'rnrn')} now"), ("b", f"Start the {word[:130]}-\n{word[130:]} now")]
    df = spark.createDataFrame([("topic_text", i, t) for i, t in rows], "src string, rec_id string, text string")
    noise = ScanNoise(df, spark.createDataFrame([("Orvo",)], "brand_name string"))
    got = {(r.rec_id, r.defect) for r in noise.damage().collect()}
    assert got == {("h0", "header"), ("h1", "header"), ("h2", "header"), ("m", "misread"), ("b", "hyphen")}
    assert {r.text for r in noise.repaired().collect() if r.rec_id in "mb"} == {f"Start the {word} now"}
    with pytest.raises(ValueError):
        brand_words(spark.createDataFrame([("a",), ("b",)], "brand_name string"), bound=1)


def test_bloom(spark):
    words = [f"w{i}" for i in range(500)]
    b = Bloom(bloom(spark.createDataFrame([(w,) for w in words], "word string")))
    assert all(w in b for w in words) and sum(f"x{i}" in b for i in range(2_000)) < 20
    assert bloom(spark.createDataFrame([(w,) for w in words], "word string"), most_bits=1 << 10) is None and "any" in Bloom(None)


# 4: languages

SAMPLES = {
    "en": ["The water filter stays dry after each cycle.", "Check whether the front cover is closed.", "Replace the pump with the new kit today."],
    "de": ["Der Wasserfilter bleibt nach jedem Zyklus trocken.", "Prüfen Sie, ob die Frontabdeckung geschlossen ist.", "Ersetzen Sie die Pumpe durch den neuen Satz."],
    "nl": ["Het waterfilter blijft na elke cyclus droog.", "Controleer of de voorkap gesloten is vandaag.", "Vervang de pomp door de nieuwe set onderdelen."],
    "fr": ["Le filtre à eau reste sec après chaque cycle.", "Vérifiez que le capot avant est bien fermé.", "Remplacez la pompe par le nouveau kit complet."],
    "da": ["Vandfilteret forbliver tørt efter hver cyklus.", "Kontrollér, om frontdækslet er lukket i dag.", "Udskift pumpen med det nye sæt af dele."],
}


def test_languages(spark):
    rows = [(i * 10 + k, lang.upper() if k == 1 else f"{lang}-XX" if k == 2 else lang, " ".join(s[k:] + s[:k]), None) for i, (lang, s) in enumerate(SAMPLES.items()) for k in range(3)]
    mixed = " ".join(SAMPLES["de"]) + " " + " ".join(SAMPLES["fr"][:2])
    extra = [(100, "da", " ".join(SAMPLES["en"]), 1), (101, None, SAMPLES["nl"][0], 1), (102, "??", "42", 1), (103, "", "", 1), (104, "de", mixed, 1), (104, "de", mixed, 1), (105, None, None, 1)]
    df = spark.createDataFrame(rows + extra, "text_id long, lang string, text string, language int")
    layout = Layout(frozenset(), frozenset())
    model = fit_language_model(df.filter("text_id < 100"), layout)
    segs = language_segments(df, model, layout)
    assert {(r.text_id, r.lang) for r in wrong_labels(segs).collect()} == {(100, "en"), (101, "nl"), (104, "de"), (104, "fr")}
    assert all(0 < r.confidence <= 1 for r in segs.collect())
    assert language_segments(df.limit(0), model, layout).count() == 0
    assert LanguageModel.fit([]).segments("water") is not None


def test_repeated_mixed_text_counts_its_sentences_once(spark):
    once = [(1, 0, 0, 90, 3, "en", 0.9, "en", 2), (1, 1, 90, 30, 1, "de", 0.9, "en", 2), (2, 0, 0, 9, 2, "en", 0.9, "en", 2), (2, 1, 9, 9, 2, "fr", 0.9, "en", 2)]
    want = [(1, "en"), (2, "en"), (2, "fr")]
    for rows in (once, once * 2):
        assert sorted(tuple(r) for r in wrong_labels(spark.createDataFrame(rows, SEGMENTS)).collect()) == want


def test_sentences():
    assert [("1. A b! c.d? e")[b:e] for b, e in sentences("1. A b! c.d? e")] == ["1.", "A b!", "c.d?", "e"]
    assert sentences("  ") == []


# 7: bilingual documents


def test_alignment(spark):
    rng = random.Random(2)
    nouns = [("filter", "Sieb"), ("pump", "Pumpe"), ("valve", "Ventil"), ("hose", "Schlauch"), ("motor", "Motor"), ("cover", "Deckel"), ("panel", "Platte"), ("ring", "Dichtung")]
    verbs = [("clean", "reinigen"), ("replace", "ersetzen"), ("check", "pruefen"), ("remove", "entfernen"), ("open", "oeffnen")]
    texts, truth = [], set()
    for topic in range(60):
        said = rng.sample([(n, v) for n in nouns for v in verbs], 5)
        en = [f"Please {v[0]} the {n[0]} within {rng.randrange(10, 99)} minutes." if k else f"Please {v[0]} the {n[0]} now." for k, (n, v) in enumerate(said)]
        number = [s.split("within ")[1].split()[0] if "within" in s else None for s in en]
        de = [f"Bitte {v[1]} Sie das {n[1]} innerhalb {x} Minuten." if x else f"Bitte {v[1]} Sie das {n[1]} jetzt." for (n, v), x in zip(said, number)]
        order = rng.sample(range(5), 5)[:4] if topic % 2 else list(range(5))
        texts += [(f"t{topic}", topic * 2, " ".join(en), "x"), (f"t{topic}", topic * 2 + 1, " ".join(de[k] for k in order), "x")]
        truth |= {(topic * 2, k, topic * 2 + 1, j) for j, k in enumerate(order)}
    texts += [("t0", 900, None, "x"), ("t1", 901, "", "x"), ("t2", 902, "12 34.", "x"), (None, 903, "Please clean the pump now.", "x"), ("zz", 904, "Please clean the pump now.", "x"), texts[0]]
    df = spark.createDataFrame(texts, "topic_id string, text_id long, text string, lang string")
    model = LanguageModel.fit([("en", t[2]) for t in texts[:120:2]] + [("de", t[2]) for t in texts[1:120:2]])
    topics = df.select("topic_id").filter("topic_id <> 'zz'").distinct()
    got = {(r.text_id_a, r.sent_a, r.text_id_b, r.sent_b) for r in align_texts(df, topics, model).collect()}
    assert len(got & truth) >= 0.97 * len(truth) and len(got & truth) >= 0.95 * len(got)
    assert align_texts(df.limit(0), topics, model).count() == 0


def test_alignment_pieces():
    assert tokens("Fill to 5,5 bar – then wait.") == ["fill", "to", "5.5", "bar", "|", "then", "wait"]
    a, b = compact("fill 5.5 bar", frozenset()), compact("füllen 5.5 bar | und warten", frozenset({"und warten"}))
    pair = Bitext(pa.array([a, a]), pa.array([b, "|"]))
    assert [x.tolist() for x in pair.anchored()] == [[0], [0]]
    assert {w.as_py() for w in pair.names.take(pa.array(pair.b.word[pair.b.free]))} == {"und", "warten"}
    means = pa.table({"of": ["en"] * 2, "word": ["fill", "bar"], "means": ["füllen", "bar"], "weight": [2.0, 1.0], "strength": [1.0, 1.0]})
    back = pa.table({"of": ["de"] * 2, "word": ["füllen", "bar"], "means": ["fill", "bar"], "weight": [2.0, 1.0], "strength": [1.0, 1.0]})
    assert [x.tolist() for x in align(pair, means, back)[:2]] == [[0], [0]]
    assert [len(x) for x in align(Bitext(pa.array(["|"]), pa.array([b])), None, None)] == [0, 0, 0]


def dense(bitext, a, b, table):
    """coverage of every pair of sentences, without an index."""
    t, out = Translations(bitext, table), np.zeros((len(a.pair), len(b.pair)))
    for i in range(len(a.pair)):
        for j in np.flatnonzero(b.pair == a.pair[i]):
            theirs, found, bag, extra = set(b.word[b.sent == j].tolist()), 0.0, 0.0, 0.0
            for w, free in zip(a.word[a.sent == i].tolist(), a.free[a.sent == i].tolist()):
                at = range(t.first[w], t.first[w] + t.count[w])
                strength = max([t.strength[k] for k in at if t.means[k] in theirs], default=0.0)
                if free and bitext.number[w]:
                    extra += 3.0 * strength
                else:
                    bag += t.weight[w] * (0.15 if free else 1)
                    found += t.weight[w] * (0.15 if free else 1) * strength
            out[i, j] = (found + extra) / max(bag + extra, 1e-9)
    return out


def test_retrieval_equals_a_dense_matrix():
    rng = random.Random(6)
    word = lambda s: f"{s}{rng.randrange(12)}" if rng.random() < 0.8 else str(rng.randrange(5))
    line = lambda s: f"{' '.join(sorted({word(s) for _ in range(rng.randrange(6))}))}|{' '.join(sorted({s + 'f', '77'} if rng.random() < 0.3 else ()))}"
    text = lambda s: "\n".join(line(s) for _ in range(rng.randrange(1, 7)))
    pair = Bitext(pa.array([text("a") for _ in range(20)]), pa.array([text("b") for _ in range(20)]))
    rows = [("a%d" % k, f"b{m}", 1.0 + k, s) for k in range(9) for m, s in ((k, 1.0), ((k + 3) % 12, 0.5))]
    table = pa.table([pa.array(c) for c in zip(*rows)], names=["word", "means", "weight", "strength"])
    want = dense(pair, pair.a, pair.b, table)
    for block in (1, 50, 4_000_000):
        key, share = retrieved(pair, pair.a, pair.b, Translations(pair, table), block=block)
        got = np.zeros(want.shape)
        got[key // len(pair.b.pair), key % len(pair.b.pair)] = share
        assert np.allclose(got, want) and (want > 0).any() and (np.diff(key) > 0).all()


def test_candidates_whose_marks_differ_go_no_further(spark, monkeypatch):
    from manualake.llm import near_duplicates as nd

    kept, cut = [], nd.cut
    monkeypatch.setattr(nd, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    common = " ".join(f"c{i}" for i in range(20))
    texts = [f"{common} " + " ".join(f"w{d}x{i}" for i in range(90)) for d in range(60)]
    texts.append(texts[0].replace("w0x50", "other"))
    docs = spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "id bigint, head string, text string")
    pairs, members = nd.near_duplicates(docs, shingle=3, threshold=0.6, least_words=25, rows=1)
    assert [(r.a, r.b) for r in nd.expand(pairs, members).collect()] == [(0, 60)]
    most = max(df.filter("not member").count() if "member" in df.columns else df.count() for df in kept if {"a", "b"} <= set(df.columns))
    assert most < 600  # of 1,830 pairs, nearly all of which share a band
