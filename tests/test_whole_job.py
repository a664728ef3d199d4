"""Results over all rows: repeats, accents, nulls and misreadings that a shortened job leaves out."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from manualake.functions.measures import bare_measure
from manualake.operators import fuzzy
from manualake.operators.fuzzy import PhraseScanner, budget, occurrence_distance, scan_phrases
from manualake.operators.units import bare_measure_udf, infer_missing_units, unit_features


def test_confident_units_are_converted(spark):
    assert [bare_measure(v, u) and tuple(bare_measure(v, u)[2:]) for v, u in (("1,5", "cm"), ("20 - 10", "m"), ("5", "none"), ("5", None), ("5 mm", "mm"))] == [(15, 15), (10_000, 20_000), None, None, None]
    df = spark.createDataFrame([("32", "°F"), ("68 ± 9", "°F"), ("0.1-0.3", "bar"), ("9" * 30, "m"), ("7", None)], "v string, u string")
    got = [tuple(r.m) for r in df.select(bare_measure_udf(F.col("v"), F.col("u")).alias("m")).collect()]
    assert got == [("temperature", 0, 0), ("temperature", 15, 25), ("pressure", 10, 30), (None, None, None), (None, None, None)]
    specs = "spec_id long, grp string, model_code string, lang string, items array<struct<k:string,v:string>>, value string"
    rows = [(i, "Size", "M", "en", [("Length", f"{100 + i} cm"), ("Count", str(i % 5))], "") for i in range(300)]
    rows += [(1000 + i, "Size", "M", "en", [("Length", str(150 + i)), ("Count", "3")], "") for i in range(5)]
    got = infer_missing_units(spark.createDataFrame(rows, specs), least=0.5, sample_bound=2_000).filter("spec_id >= 1000").collect()
    assert {(r.item_no, r.route) for r in got} == {(0, "convert"), (1, "none")}
    assert all((r.quantity, r.low, r.high) == (("length", int(r.value) * 10, int(r.value) * 10) if r.route == "convert" else (None,) * 3) for r in got)


def test_numbers_under_a_null_label_stay(spark):
    specs = "spec_id long, grp string, model_code string, lang string, items array<struct<k:string,v:string>>, value string"
    rows = [(1, "g", "m", "en", [(None, "12"), ("", "13"), ("Length", "14 mm")], "")]
    got = unit_features(spark.createDataFrame(rows, specs)).select("item_no", "stem").collect()
    assert sorted(tuple(r) for r in got) == [(0, ""), (1, ""), (2, "length")]


def test_misread_phrases_are_all_found(spark):
    seen = ["a leek left sede here", "leakleft side", "le ak left side", "no fan in it", "leak left side"]
    frames = spark.createDataFrame(list(enumerate(seen)), "frame long, text string")
    found = scan_phrases(frames, spark.createDataFrame([("Leak left side",), ("fan in it",)], "phrase string"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "Leak left side", 92), (1, "Leak left side", 92), (2, "Leak left side", 92), (3, "fan in it", 98), (4, "Leak left side", 98)]


def test_phrases_equal_brute_force():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcde1", k=rng.randint(1, 7)))
    keys = sorted({k for k in (" ".join(word() for _ in range(rng.randint(2, 30))) for _ in range(300)) if len(k) >= 6})
    texts = []
    for _ in range(120):
        k = list(" ".join([word(), rng.choice(keys), word()]))
        for _ in range(rng.randint(0, 6)):
            k[rng.randrange(len(k))] = rng.choice(["", "a", "x", "ab", " "])
        texts.append("".join(k))
    texts += ["", "a", max(keys, key=len)]
    want = {(f, k, 98) for f, t in enumerate(texts) for k, key in enumerate(keys) if key in t}
    want |= {(f, k, 92) for f, t in enumerate(texts) for k, key in enumerate(keys) if len(key) >= 10 and key not in t and occurrence_distance(key, t) <= budget(key)}
    assert len({c for _, _, c in want}) == 2 and sorted(PhraseScanner(keys).scan(texts, 4_000)) == sorted(want)


def test_rare_pieces_lose_no_phrase(monkeypatch):
    monkeypatch.setattr(PhraseScanner, "LETTERS", 2_000)
    monkeypatch.setattr(PhraseScanner, "STRETCHES", 3_000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcde1", k=rng.randint(1, 7)))
    keys = sorted({k for k in (" ".join(word() for _ in range(rng.choice((2, 3, 4, 9, 18, 60)))) for _ in range(60)) if len(k) >= 6})
    texts = []
    for _ in range(60):
        k = list(" ".join([*(word() for _ in range(rng.randint(0, 2))), rng.choice(keys), *(word() for _ in range(rng.randint(0, 2)))]).strip())
        for _ in range(rng.randint(0, 4 if len(k) < 60 else 14)):
            k[rng.randrange(len(k))] = rng.choice(["", "a", "x", "ab", " "])
        texts.append("".join(k))
    texts += ["", "a", " ".join(keys[:9])]
    longest = 250
    want = {(f, k, 98) for f, t in enumerate(texts) for k, key in enumerate(keys) if key in t}
    want |= {(f, k, 92) for f, t in enumerate(texts) for k, key in enumerate(keys) if len(key) >= 10 and len(t) <= longest and key not in t and occurrence_distance(key, t) <= budget(key)}
    assert any(len(keys[k]) > 64 for _, k, c in want if c == 92) and any(len(t) > longest for t in texts)
    for given in (texts, ["", "zzz"]):
        pieces = fuzzy.rare_pieces(keys, given)
        for key, own in zip(keys, pieces):
            assert len(own) == (budget(key) + 1 if len(key) >= 10 else 0) and all(0 <= b < e <= len(key) for b, e in own)
            assert all(x[1] <= y[0] for x, y in zip(sorted(own), sorted(own)[1:]))
        assert sorted(PhraseScanner(keys, pieces=pieces).scan(texts, longest)) == sorted(want)
    assert PhraseScanner([]).scan(texts, longest) == [] == PhraseScanner(keys).scan([], longest)


def test_common_words_bring_few_stretches(monkeypatch):
    """The distance is not taken of every phrase to every text that shares a word with it."""
    rng, asked = random.Random(9), []
    code = lambda: "".join(rng.choices("bcdfghjk23456789", k=3))
    keys = sorted({f"adjusting the water filter and the drive belt {code()} {code()}" for _ in range(500)})
    texts = [f"clean the water filter and look at the drive belt {code()}" for _ in range(100)] + ["adjusting te water filter and the drive belt " + keys[0][-7:]]
    within = PhraseScanner._within
    monkeypatch.setattr(PhraseScanner, "_within", lambda self, key, *more: asked.append(len(key)) or within(self, key, *more))
    assert (100, 0, 92) in PhraseScanner(keys).scan(texts, 4_000) and sum(asked) < 5_000


def test_positions_of_all_sections(spark, tmp_path):
    rows = [("p1", "12", "05"), ("p2", "12", "5"), ("p2", "12", "5"), ("p3", "7", "5"), ("p4", "7", "005"), ("p5", None, "5"), ("p6", "7", None)]
    spark.createDataFrame(rows, "part_id string, section string, pos string").write.parquet(f"{tmp_path}/part_row.parquet")
    got = entry.queries()["jn25_position_join"](spark, str(tmp_path)).collect()
    assert sorted((r.part_id, r["first"], r.n) for r in got) == [("p1", "p1", 2), ("p2", "p1", 2), ("p3", "p3", 2), ("p4", "p3", 2), ("p5", "p5", 1)]


def by_topic(spark, tmp_path, titles, name):
    rows = [(str(i), "fault", "um", t) for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "topic_id string, kind string, doctype string, title string").write.mode("overwrite").parquet(f"{tmp_path}/topic.parquet")
    return entry.queries()[name](spark, str(tmp_path)).collect()


def test_rows_beyond_ascii_are_counted(spark, tmp_path):
    titles = ["Störung  X", "störung\u00a0x", "Zia\u00ae", "zia", "e\u0301t\u00e9", None]
    prints = {r.topic_id: r.fingerprint for r in by_topic(spark, tmp_path, titles, "str3_fingerprints")}
    assert prints["0"] == prints["1"] and prints["2"] == prints["3"] and len(set(prints.values())) == 3
    keys = {r.topic_id: r.k for r in by_topic(spark, tmp_path, titles, "str34_match_key")}
    assert keys == {str(i): re.sub(r"\W+", "", t.lower()) for i, t in enumerate(titles) if t is not None}
    rows = [(i, "b", str(i), "en", None, f"Bedienungsanleitung f\u00fcr Ger\u00e4te {i}\nR\u00f8r f\u00fcr filter pumpe") for i in range(3)]
    spark.createDataFrame(rows, "text_id long, doc_id string, topic_id string, lang string, title string, text string").write.parquet(f"{tmp_path}/topic_text.parquet")
    got = entry.queries()["agg18_running_lines"](spark, str(tmp_path)).collect()
    assert {(r.k, r.n) for r in got} == {("Bedienungsanleitung f\u00fcr Ger\u00e4te #", 3), ("R\u00f8r f\u00fcr filter pumpe", 3)}
    by_topic(spark, tmp_path, ["a", "b", "c"], "str34_match_key")
    terms = {r.term for r in entry.queries()["idx1_postings"](spark, str(tmp_path)).collect()}
    assert {"r\u00f8r", "fur", "gerate"} <= terms
    for name, n in (("idx3_bm25_effective", 3), ("srt11_search_from_the_index", 3), ("idx3_bm25_intended", 0)):
        assert entry.queries()[name](spark, str(tmp_path)).count() == n


def test_titles_beyond_latin_are_folded(spark, tmp_path):
    titles = ["\uff37ater \ufb01lter\u2013x\u00b2", "wa\u0300ter \u1ea1 filter", "St\u00f8j\u200b storing \u2013", None]
    by = lambda name: {r[0]: r[1] for r in by_topic(spark, tmp_path, titles, name)}
    assert by("str1_slug") == {"0": "water-filter-x2", "1": "water-a-filter", "2": "st-j-storing"}
    assert by("str35_search_key") == {"0": "ater lter x", "1": "water a filter", "2": "st j storing"}
    assert by("str26_ordered_rules") == {"0": "other", "1": "other", "2": "fault"}
    assert list(by("srt10_best_sixty")) == ["1"]


def test_tables_of_many_files_are_listed_once(spark, tmp_path):
    root = tmp_path / "a b"
    for name in ("product", "topic"):
        spark.range(6).repartition(3).write.parquet(f"{root}/{name}.parquet")
    (root / "part.parquet").write_bytes(next((root / "topic.parquet").glob("part-*.parquet")).read_bytes())
    got = entry.queries()["src1_inventory"](spark, str(root)).collect()
    assert sorted(r.name for r in got) == ["part.parquet", "product.parquet", "topic.parquet"]


@pytest.mark.parametrize("name, n", [("agg28_distinct_hits", 5), ("fzy6_best_hits", 5), ("srt12_top_eight", 5), ("fzy2_printed_phrases", 5), ("jn27_frames_and_messages", 2)])
def test_sure_hits_need_no_near_words(spark, tmp_path, monkeypatch, name, n):
    monkeypatch.setattr(fuzzy, "near_words", None)
    rows = [(1, "the Leak left side, a fan"), (2, "leek left side"), (3, None), (4, "leak left side leak left side")]
    spark.createDataFrame(rows, "text_id long, text string").write.parquet(f"{tmp_path}/topic_text.parquet")
    got = by_topic(spark, tmp_path, ["Leak left side", "left side", "a fan", "Leak left side", None], name)
    assert len(got) == n


def test_bags_equal_brute_force():
    rng = random.Random(5)
    bags = [rng.sample(range(30), rng.randint(4, 9)) for _ in range(400)]
    scanner = fuzzy.BagScanner(bags, 30)
    for size in (0, 3, 8, 15, 30):
        there = rng.choices(range(30), k=size)
        assert scanner.scan(there).tolist() == [i for i, b in enumerate(bags) if len(set(b) & set(there)) * 100 / len(b) >= 80]


def test_bags_in_blocks(spark):
    seen = spark.createDataFrame([(1, ["leaking", "filter", "tank", "water", "side"]), (2, ["filtre", "tank"]), (3, [])], "frame long, seen array<string>")
    bags = spark.createDataFrame([(f"p{i}", ["leaking", "filter", "water", "tank", f"odd{i}xyz"]) for i in range(9)] + [("q", ["tank", "side", "filter", "other"])], "phrase string, words array<string>")
    for block in (3, 50_000):
        assert sorted(tuple(r) for r in fuzzy.bag_hits(seen, bags, block=block).collect()) == [(1, f"p{i}") for i in range(9)]


def test_long_and_busy_frames_lose_no_phrase(spark):
    long = "nothing to see on this page " * 200
    busy = " ".join(f"word{i:05d}" for i in range(500))
    seen = [f"{long} leek left sede {long}", f"{busy} tank {long} empty {busy} water {long} pumping", f"{long} leak left side", long, busy]
    frames = spark.createDataFrame(list(enumerate(seen)), "frame long, text string")
    found = scan_phrases(frames, spark.createDataFrame([("Leak left side",), ("Pumping water, tank empty",)], "phrase string"))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "Leak left side", 92), (1, "Pumping water, tank empty", 80), (2, "Leak left side", 98)]


@pytest.mark.parametrize("letters", [1, 150, 700])
def test_phrases_of_long_texts_equal_brute_force(monkeypatch, letters):
    monkeypatch.setattr(PhraseScanner, "LETTERS", letters)
    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcde1", k=rng.randint(1, 7)))
    keys = sorted({k for k in (" ".join(word() for _ in range(rng.choice((2, 3, 5, 18)))) for _ in range(80)) if len(k) >= 6})
    texts = []
    for _ in range(12):
        k = list(" ".join(rng.choice([word(), rng.choice(keys)]) for _ in range(rng.randint(30, 90))))
        for _ in range(len(k) // 12):
            k[rng.randrange(len(k))] = rng.choice(["", "a", "x", "ab", " "])
        texts.append("".join(k))
    want = {(f, k, 98) for f, t in enumerate(texts) for k, key in enumerate(keys) if key in t}
    want |= {(f, k, 92) for f, t in enumerate(texts) for k, key in enumerate(keys) if len(key) >= 10 and key not in t and occurrence_distance(key, t) <= budget(key)}
    assert len({c for _, _, c in want}) == 2 and sorted(PhraseScanner(keys).scan(texts)) == sorted(want)


def test_bags_of_busy_frames_in_parts_equal_brute_force(monkeypatch):
    monkeypatch.setattr(fuzzy.BagScanner, "PAIRS", 300)
    rng = random.Random(6)
    bags = [rng.sample(range(40), rng.randint(4, 9)) for _ in range(400)]
    seen = [rng.choices(range(40), k=size) for size in (0, 5, 30, 60, 0, 200, 3, 0)]
    frame, bag = fuzzy.BagScanner(bags, 40).scan_frames(fuzzy.np.repeat(range(len(seen)), [len(x) for x in seen]), fuzzy.np.array(sum(seen, [])), len(seen))
    want = [(f, i) for f, x in enumerate(seen) for i, b in enumerate(bags) if len(set(b) & set(x)) * 100 / len(b) >= 80]
    assert len(want) > 400 and list(zip(frame.tolist(), bag.tolist())) == want


def test_bags_are_found_in_busy_frames(spark, tmp_path):
    busy = " ".join(f"word{i:05d}" for i in range(900))
    rows = [("a", f"Pumpimg water, {busy} tank empty"), ("b", "tank empty water pumping"), ("c", busy), ("d", f"tank {busy} empty"), ("e", None)]
    spark.createDataFrame(rows, "text_id string, text string").write.parquet(f"{tmp_path}/topic_text.parquet")
    got = by_topic(spark, tmp_path, ["Pumping water, tank empty", "Pumping cold water, tank empty", None], "fzy4_bags_of_words")
    assert sorted((r.frame, r.phrase) for r in got) == [(f, p) for f in "ab" for p in ("Pumping cold water, tank empty", "Pumping water, tank empty")]
