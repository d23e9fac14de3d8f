"""The llm operators against brute force, round trips and hand-made cases."""

import pickle
import random
import string
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph import session
from weftgraph.llm import components as components_module
from weftgraph.llm import leaks, sentences
from weftgraph.llm.components import components, mix, unmix
from weftgraph.llm.copies import canonical_record, mark_copies, split_buckets, terminals
from weftgraph.llm.dictionaries import Lexicon, installed_lexicon
from weftgraph.llm.leaks import TEXT_END, Patterns, find_leaks, folded
from weftgraph.llm.neighbours import nearest, neighbour_pairs, usable
from weftgraph.llm.packing import pack_documents, packing_checks, sum_of_squares
from weftgraph.llm.sentences import sentence_units, unit_starts
from weftgraph.operators import heavy


def rows(df):
    return sorted(tuple(r) for r in df.collect())


# -- components --------------------------------------------------------------------------------------------------------
def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x in (a, b):
            if x is not None:
                find(x)
        if a is not None and b is not None:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    return sorted((x, find(x)) for x in parent)


def pairs_frame(spark, pairs):
    return spark.createDataFrame([(a, b, 0, "x") for a, b in pairs], "a long, b long, v int, r string")


def test_components_of_stars_chains_and_loose_ends(spark, monkeypatch):
    r = random.Random(1)
    star = [(0, i) for i in range(1, 800)] + [(i, 0) for i in range(400, 800)]
    chain = [(i, i + 1) for i in range(10_000, 10_400)]
    shuffled = list(range(20_000, 20_300))
    r.shuffle(shuffled)
    second = list(zip(shuffled, shuffled[1:]))
    loose = [(None, 5), (50_000, None), (None, None), (60_000, 60_000), (2**61, 2**61 - 1), (70_000, 70_001), (70_001, 70_000)]
    pairs = star + chain + second + loose + [(799, 30_000), (30_000, 30_001), (30_001, 30_002)]
    df = pairs_frame(spark, pairs)
    assert rows(components(df, "a", "b")) == union_find(pairs)
    # Even where peeling ends before the giant is reached whole, and where no side is broadcast.
    assert rows(components(df, "a", "b", tail=0)) == union_find(pairs)
    for module in (session, heavy, components_module):
        monkeypatch.setattr(module, "BROADCAST_ROWS", 20)
    assert rows(components(df, "a", "b")) == union_find(pairs)


def test_components_without_edges(spark):
    assert rows(components(pairs_frame(spark, []), "a", "b")) == []
    assert rows(components(pairs_frame(spark, [(3, 3), (4, None)]), "a", "b")) == [(3, 3), (4, 4)]


def test_mixing_is_a_bijection(spark):
    ids = spark.range(1000).selectExpr("id * 4611686018427387 AS x").unionByName(spark.range(100).selectExpr("id AS x"))
    got = ids.select("x", mix(F.col("x")).alias("m"), unmix(mix(F.col("x"))).alias("u"))
    assert got.filter("x <> u OR m < 0").isEmpty() and got.select("m").distinct().count() == ids.distinct().count()


# -- copies ------------------------------------------------------------------------------------------------------------
@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab\x00é", max_size=20), min_size=1, max_size=40))
def test_trie_terminals_are_the_distinct_records(records):
    ends, n = terminals(pa.array(records))
    assert n == len(set(records)) and len({(e, r) for e, r in zip(ends.tolist(), records, strict=True)}) == n and set(ends.tolist()) == set(range(n))


def expected_copies(data):
    first, count = {}, Counter()
    for i, k in data:
        if k is not None:
            first[k] = min(i, first.get(k, i))
            count[k] += 1
    return sorted((i, first[k], count[k]) for i, k in data if k is not None)


@pytest.mark.parametrize("least", [3, 40, 20_000])
def test_copies_with_a_hot_record(spark, least):
    r = random.Random(2)
    keys = ["hot" * 6] * 300 + ["hot" * 6 + "x"] * 80 + ["hot" + "".join(r.choices("abc", k=r.randint(0, 9))) for _ in range(400)] + [None, "", "", "日本語テキスト", "日本語テキスト"]
    r.shuffle(keys)
    data = list(enumerate(keys))
    df = spark.createDataFrame([(i, k, 0, "p") for i, k in data], "id long, k string, bin int, prefix string")
    assert rows(mark_copies(df, "id", F.col("k"), least=least, buckets=8)) == expected_copies(data)


def test_canonical_form(spark):
    df = spark.createDataFrame([(0, " A-b ", "C"), (1, "c.", "ab"), (2, None, "!"), (3, "x", None), (4, "ÄÖ", "1")], "i int, a string, b string")
    got = [r["c"] for r in df.select("i", canonical_record(F.col("a"), F.col("b")).alias("c")).orderBy("i").collect()]
    assert got[0] == got[1] == "ab\x1fc" and got[2] is None and got[3] == "\x1fx" and got[4] == "1\x1fäö"


def test_copies_of_very_long_records_and_none(spark):
    long = "z" * 200_000
    df = spark.createDataFrame([(1, long), (2, long), (3, long + "a")], "id long, k string")
    assert rows(mark_copies(df, "id", F.col("k"))) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
    assert rows(mark_copies(df.limit(0), "id", F.col("k"))) == []


def test_a_long_common_prefix_costs_few_levels(spark):
    head = "h" * 10_000
    data = [(i, head + f"{i % 290:04d}" + "t" * (i % 7)) for i in range(600)] + [(1000 + i, "other") for i in range(3)] + [(2000 + i, head) for i in range(150)]
    df = spark.createDataFrame(data, "id long, k string")
    assert rows(mark_copies(df, "id", F.col("k"), least=100)) == expected_copies(data)
    placed, levels = split_buckets(df.select(F.col("id").alias("row_id"), F.col("k").cast("binary").alias("rec")), 100, 753)
    assert levels <= 3 and placed.groupBy("leaf").count().agg(F.max("count")).first()[0] <= 150


# -- neighbours --------------------------------------------------------------------------------------------------------
def vectors(n, clusters, seed, d=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, d))
    return (centres[rng.integers(clusters, size=n)] + 0.05 * rng.normal(size=(n, d))) * rng.uniform(0.1, 9, size=(n, 1))


def brute_neighbours(x, k):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(-s[i], kind="stable")[:k]}


@pytest.mark.parametrize("bucket", [4_096, 20])
def test_recall_of_neighbours(spark, bucket):
    x = vectors(900, 25, 3)
    df = spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vid long, factor array<double>, t int")
    got = nearest(df, "vid", "factor", 8, 5, bucket=bucket, radius=0.4)
    found, want = {(r[0], r[1]) for r in got.collect()}, brute_neighbours(x, 5)
    assert len(found & want) / len(want) >= 0.97 and max(Counter(a for a, _ in found).values()) == 5
    pairs = rows(neighbour_pairs(got))
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs)


def test_unusable_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [3.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [1.0]), (8, [nan, 1.0]), (9, [inf, 1.0]), (10, [None, 1.0]), (None, [1.0, 1.0]), (11, [1e300, 1e300])]
    df = spark.createDataFrame(data, "vid long, factor array<double>")
    assert [r["vid"] for r in df.filter(usable(F.col("factor"), 2)).orderBy("vid").collect()] == [None, 1, 2, 3, 11]
    got = rows(nearest(df, "vid", "factor", 2, 2))
    assert [(a, b) for a, b, _ in got if a < 4] == [(1, 2), (1, 3), (2, 1), (2, 3), (3, 1), (3, 2)]
    assert rows(nearest(df.limit(1), "vid", "factor", 2)) == [] and rows(nearest(df.limit(0), "vid", "factor", 2)) == []


def test_many_equal_vectors(spark):
    df = spark.range(300).select(F.col("id").alias("vid"), F.array(F.lit(1.0), F.lit(2.0)).alias("factor"))
    got = nearest(df, "vid", "factor", 2, 3, bucket=64)
    assert got.count() == 900 and got.filter("sim < 0.999999").isEmpty()
    assert {r["vid"]: 1 for r in got.select("vid").distinct().collect()}.keys() == set(range(300))
    # Equal vectors aren't compared with each other beyond the first few.
    assert [(r["other"]) for r in got.filter("vid = 200").orderBy("other").collect()] == [0, 1, 2]


# -- packing -----------------------------------------------------------------------------------------------------------
@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=80))
def test_sum_of_squares_is_the_best_choice_each_time(sizes):
    capacity = 50
    where, held = sum_of_squares(np.array(sizes), capacity)
    gaps: dict[int, int] = {}
    square = lambda g: sum(n * n for n in Counter(x for x in g.values() if 0 < x < capacity).values())
    for s, b in zip(sizes, where.tolist(), strict=True):
        options = [square(gaps | {c: g - s}) for c, g in gaps.items() if g >= s] + [square(gaps | {len(gaps): capacity - s})]
        gaps = gaps | {b: gaps.get(b, capacity) - s}
        assert gaps[b] >= 0 and square(gaps) == min(options)
    assert held.tolist() == [capacity - gaps[b] for b in range(len(held))]


@pytest.mark.parametrize("shard_items", [50_000, 15])
def test_every_document_is_placed(spark, shard_items):
    r = random.Random(4)
    texts = [" ".join(r.choices(["one", "tiny", "word", "文章"], k=r.randint(1, 90))) for _ in range(60)] + ["long " * 300, None, "", "  \n", "<|endoftext|>", "字" * 500]
    df = spark.createDataFrame([(i, t, "b") for i, t in enumerate(texts)], "doc_id long, text string, bin_id string")
    got = pack_documents(df, capacity=64, shard_items=shard_items).collect()
    load = Counter()
    parts = defaultdict(list)
    for p in got:
        load[p["bin_id"]] += p["n_tokens"]
        parts[p["doc_id"]].append((p["part"], p["first_token"], p["n_tokens"]))
    assert max(load.values()) <= 64 and set(parts) == {i for i, t in enumerate(texts) if t and t.strip()}
    for p in parts.values():
        p.sort()
        assert [k for k, _, _ in p] == list(range(len(p))) and all(f == 64 * k for k, f, _ in p) and all(n == 64 for _, _, n in p[:-1])
    assert sum(load.values()) / (64 * len(load)) > 0.8
    assert rows(pack_documents(df.limit(0))) == []
    checks = packing_checks(pack_documents(df, capacity=64, shard_items=shard_items), 64).first()
    assert checks["n_documents"] == len(parts) and checks["whole_and_once"] and checks["none_overfull"]


# -- leaks -------------------------------------------------------------------------------------------------------------
def plain(t):
    return "".join(c for c in t.lower() if c.isalnum())


def brute_leaks(docs, items):
    grams = defaultdict(set)
    for i, t in items:
        n = plain(t or "")
        for k in range(len(n) - 39):
            grams[n[k : k + 40]].add(i)
    return sorted({(d, i) for d, t in docs for n in [plain(t or "")] for k in range(len(n) - 39) for i in grams.get(n[k : k + 40], ())})


def leak_data(seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choices("abcdeé日本", k=n))
    items = [(i, word(r.randint(20, 160))) for i in range(12)] + [(90, None), (91, ""), (92, "short"), (93, "aa" * 60)]
    docs = []
    for d in range(60):
        i, t = r.choice(items[:12])
        a = r.randint(0, len(t))
        part = t[a : a + r.choice([38, 39, 40, 41, 80, 200])]
        noisy = "".join(c.upper() + r.choice(["", "", " ", "-\n", "…"]) for c in part)
        docs.append((d, word(r.randint(0, 60)) + "!" + noisy + "?" + word(r.randint(0, 700))))
    return [*docs, (70, None), (71, ""), (72, "a" * 3000), (73, items[0][1] + items[1][1])], items


@pytest.mark.parametrize("chars", [4_000_000, 300])
def test_leaks_against_brute_force(spark, monkeypatch, chars):
    monkeypatch.setattr(leaks, "ITEM_CHARS", chars)
    monkeypatch.setattr(leaks, "BLOCKS_AT_ONCE", 2)
    docs, items = leak_data(5)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    e = spark.createDataFrame([(i, t, "en") for i, t in items], "item_id long, text string, lang string")
    assert rows(find_leaks(d, e)) == brute_leaks(docs, items)


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10_000))
def test_search_against_brute_force(seed):
    docs, items = leak_data(seed)
    docs, items = [x for x in docs if x[1] is not None], [x for x in items if x[1] is not None]
    a, b = Patterns([i for i, _ in items], [t for _, t in items]).search(*folded([t for _, t in docs], TEXT_END))
    assert sorted((docs[x][0], int(y)) for x, y in zip(a, b, strict=True)) == brute_leaks(docs, items)


def test_no_items_and_no_documents(spark):
    d = spark.createDataFrame([(1, "x" * 100)], "doc_id long, text string")
    e = spark.createDataFrame([(1, "x" * 100)], "item_id long, text string")
    assert rows(find_leaks(d, e.limit(0))) == [] and rows(find_leaks(d.limit(0), e)) == [] and rows(find_leaks(d, e)) == [(1, 1)]


# -- sentences ---------------------------------------------------------------------------------------------------------
CASES = [
    "Agenda item 7: the bridge tolls|\n|The Chair:|\n|It cost 3.50 in Jan. and more in Sept. |Mr. A. Smith, Mrs. Lee et al. agreed. |“Really? Now?” asked Dr. Poe. |Order!",
    "They waited… and waited… until p. 3, i.e. the end. |(Laughter. More.) |The rate (see vol. 2, p. 9) rose.|We want 1. this, 2. No. 9 and 3. that. |He said: “It is done. That is enough.” |Why?! |No",
    "we left at 8 p.m. |nothing has changed since 30 jan. |is that fair? |(applause) |it cost 4.5 million.",
    "Tagesordnungspunkt 3: Vamu|\n\n|Das regelt § 21 Abs. 3 S. 6 der Ordnung. |Seit dem 15. Juni ist z. B. ca. 3 Mio. Taler weg. |„Wer zahlt?“, fragte Hr. Ott. |Nein.",
    "M. LE MAIRE :|\n|Le coût fut d'env. 30,2 millions. |« Qui paie ? » demande M. Roy. |Cf. p. 4, c.-à-d. le reste. |Pour qui donc ?!",
    "¿Es justo? |¡Silencio! |La Sra. Paz nos dijo: «Se acabó. Basta.» |Queremos 1.º esto y 2.º aquello.",
    "日程第3　ミトラ|\n|議長：|\n|いいえ。|「なぜですか？」と議長が尋ねました。|（拍手）|それは……そうです。|もう待てません！",
    "议程第8项　陶涅|\n|部长问：“真的吗？现在？”随后走了。|为什么？|不。",
    "मद 8: नेहोर|\n|डॉ. राम ने पृ. 5 पढ़ा। |“क्यों?” राम ने पूछा| |नहीं।",
    "ระเบียบวาระที่ 2 นาเทว|\n|ขอพักการประชุมครับ |ตามข้อ 3.5 การประปาได้ถอนวาระที่สอง |น่าเสียดายที่ดร. ทาเลนเลื่อนวาระที่สอง เพราะฝ่ายค้านถอนวาระที่สองค่ะ |(ปรบมือ) |ยุติธรรมไหม",
    "Corrected version|\n|Once.|Two words here. |Three",
    # Plain texts of no parliament.
    "私は学生だ |彼は先生だ |明日は休みだ",
    "今日は天気がいいです|明日は雨が降ります",
    "寒いですが、出かけますのでお待ちください。|はい。",
    "他昨天来过 |我们已经谈好了 |天气很冷",
    "你吃了吗|我吃了",
    "ฉันชอบกินข้าว |แม่ทำอาหารอร่อยมาก",
    "เขาไปตลาด |ซื้อปลา แล้วกลับบ้าน",
    "We chose plan B. |It works well. |I live in the U.S. |The weather is nice.",
    "She takes vitamin C. |Then she rests. |Gen. Lee met Capt. Roy. |Rev. Poe and Sen. Ott left.",
    "J. A. Smith and E. Poe came. |z. B. Die Frau. |He died in 1990. |We saw No. 5.",
    "هل أنت بخير؟ |نعم۔ |شكرا",
    "သူ သွားသည်။ |ငါ နေသည်၊ ပြီးတော့ စားသည်။",
    "គាត់ទៅផ្សារ។ |ខ្ញុំនៅផ្ទះ។",
    "ຂ້ອຍກິນເຂົ້າ |ເຂົາໄປຕະຫຼາດ",
]


@pytest.mark.parametrize("marked", CASES)
def test_units(marked):
    # A bar followed by a line break, or after one, only marks the boundary; Hindi's own bar stays.
    pieces, text, starts = marked.replace("पूछा| |", "पूछा\x00 |").split("|"), "", []
    for p in pieces:
        p = p.replace("\x00", "|")
        if p.strip():
            starts.append(len(text))
        text += p
    assert unit_starts(text) == starts, [text[a:b] for a, b in zip(unit_starts(text), [*unit_starts(text)[1:], len(text)])]


@pytest.mark.parametrize("heading", ["Prof. Wenri Ebselov:", "PROF. RIGAR RISELWENARD (Orchard League):", "Vizepräsident Prof. Zansel Tastauna:"])
def test_a_title_with_a_full_stop_is_part_of_a_heading(heading):
    assert unit_starts(f"{heading}\nThank you. We go on.") == [0, len(heading) + 1, len(heading) + 12]
    assert unit_starts("That was agreed. He said the following:\nno more.")[:2] == [0, 17]


def test_lattice_takes_dictionary_words():
    words = installed_lexicon()
    assert words.lattice("ขอบคุณท่านประธานครับ", "thai") == ["ขอบคุณ", "ท่าน", "ประธาน", "ครับ"]
    assert words.lattice("今日は天気がいいです", "cjk") == ["今日", "は", "天気", "が", "いい", "です"]
    assert "".join(words.lattice("abประธานx", "thai")) == "abประธานx" and words.lattice("", "thai") == []
    own = Lexicon({"thai": "กข\nกขค\t10\nง", "cjk": "日本\t5\n日\t50\n本\t50", "lao": ""})
    assert own.lattice("กขคง", "thai") == ["กขค", "ง"] and pickle.loads(pickle.dumps(own)).lattice("日本日", "cjk") == ["日本", "日"]
    assert len(own.lattice("ກກ", "lao")) == 2


def test_every_terminal_is_looked_for():
    assert all(c in sentences.COMMON_TERMINALS or sentences.OTHER_SCRIPTS.match(c) for c in sentences.TERMINALS) and len(sentences.TERMINALS) > 100
    assert unit_starts("Բարև։ Ողջույն։ Այո") == [0, 6, 15]


def test_dictionaries_are_read_whole():
    sizes = {script: text.count("\n") for script, text in installed_lexicon().lists.items()}
    assert sizes["thai"] > 20_000 and sizes["lao"] > 20_000 and sizes["cjk"] > 200_000
    words = dict(line.split("\t") for line in installed_lexicon().lists["cjk"].split("\n"))
    assert int(words["の"]) < int(words["今日"]) and all(len(w) > 0 for w in words)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="aB1 .!?\n()“”«»:।。ก นะครับ「」[]\"'…|", max_size=80))
def test_any_text_gives_rising_positions(text):
    got = unit_starts(text)
    assert got == sorted(set(got)) and all(not text[p].isspace() for p in got)
    assert bool(got) == bool(text.strip())


def test_units_of_documents(spark):
    long = "One sentence here. " * 50_000
    data = [(1, "Alpha ran. Beta sat."), (2, None), (3, " \n "), (4, long), (1, "Alpha ran. Beta sat.")]
    df = spark.createDataFrame([(i, t, 5) for i, t in data], "doc_id long, text string, start_pos int")
    got = Counter(r["doc_id"] for r in sentence_units(df).collect())
    assert got == {1: 4, 4: 50_000} and rows(sentence_units(df.limit(0))) == []


def test_random_strings_do_not_break_anything():
    r = random.Random(0)
    for _ in range(300):
        unit_starts("".join(r.choices(string.printable + "。「」（）“”«»กขค।", k=60)))
