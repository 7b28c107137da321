"""Problems 3, 4, 6, 7 and 8 against brute force, exact round trips and fixed expectations."""

import os
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from hypothesis import given, settings, strategies as st

from fieldloom.llm import encoding as E, packing as K, retellings as R, sentences as S, spans as P, text as X, tokenizers as T

RECORD = "record_id bigint, body string, cls string, sig string, n string, prefix string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau ypsilon".split()


def records(spark, bodies):
    return spark.createDataFrame([(i, b, "c", "s", "n", "p") for i, b in enumerate(bodies)], RECORD)


def jaccard_pairs(bodies, threshold=0.7):
    word = regex.compile(r"[\p{L}\p{N}_]+")
    sets = {}
    for i, b in enumerate(bodies):
        w = word.findall(b.lower()) if b else []
        if len(w) >= 40:
            sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return words


def test_retellings_equal_brute_force(spark, tmp_path):
    rng = random.Random(2)
    bodies = [None, "", "too short", "x " * 39]
    for _ in range(30):
        base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.choice((45, 80, 200)))]
        bodies += [" ".join(edited(rng, base, rng.choice((0, 1, 3, 6, 9)))) for _ in range(4)]
    bodies += [bodies[4]] * 12 + [bodies[4].upper(), "same word " * 60, "same  WORD " * 60]
    data = records(spark, bodies)
    data.write.parquet(str(tmp_path / "tape_records.parquet"))
    got = [tuple(r) for r in R.p3_found(spark, str(tmp_path)).select("record_a", "record_b").collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(bodies)


def test_retellings_join_hot_bands_block_by_block(spark):
    rng = random.Random(3)
    base = [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(120)]
    bodies = [" ".join(edited(rng, base, 3)) for _ in range(40)]
    links, _ = R.class_links(records(spark, bodies), block=6)
    got = [(r.a, r.b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == jaccard_pairs(bodies) and len(got) > 300


def test_retellings_of_nothing(spark, tmp_path):
    records(spark, []).write.parquet(str(tmp_path / "tape_records.parquet"))
    assert R.p3_found(spark, str(tmp_path)).count() == 0


def test_pruning_keeps_likely_pairs():
    assert list(R.least_matches())[0] <= 8 and R.least_matches()[-1] < 0.7 * R.SIGNATURE
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 30, (200, R.SIGNATURE)).astype(np.uint32)
    b = np.where(rng.random(a.shape) < 0.75, a, a + 1).astype(np.uint32)
    assert R.may_reach(a, b).mean() > 0.99
    c = np.where(rng.random(a.shape) < 0.2, a, a + 1).astype(np.uint32)
    assert not R.may_reach(a, c).any()


def brute_spans(bodies, span):
    where = {}
    for i, b in enumerate(bodies):
        for k in range(len(b or "") - span + 1):
            where.setdefault(b[k : k + span], set()).add(i)
    out = set()
    for i, b in enumerate(bodies):
        current = None
        for k in range(len(b or "") - span + 1):
            if len(where[b[k : k + span]]) > 1:
                if current and k <= current[1]:
                    current[1] = k + span
                else:
                    if current:
                        out.add((i, *current))
                    current = [k, k + span]
        if current:
            out.add((i, *current))
    return out


@pytest.mark.parametrize("hot", [100_000, 5])
def test_spans_equal_brute_force(spark, hot):
    rng = random.Random(7)
    letters = "ab c\n😀é"
    piece = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [piece(rng.randrange(15, 60)) for _ in range(6)]
    bodies = [None, "", "short", "a" * 90, "a" * 70, piece(40) * 3]
    for _ in range(25):
        bodies.append("".join(rng.choice((piece(rng.randrange(30)), rng.choice(shared))) for _ in range(6)))
    bodies += [bodies[8]] * 9
    got = P.shared_spans(records(spark, bodies), span=20, prefix=10, hot_rows=hot).collect()
    assert {(r.record_id, r.span_start, r.span_end) for r in got} == brute_spans(bodies, 20) and len(got) > 20


def test_deep_nodes_hold_what_recurs():
    texts = ["xxabcdefyy", "zabcdefz", "abcdxabcd"]
    nodes = {texts[o][j : j + 4]: sorted(where) for where in P.deep_nodes(texts, 4) for o, j in where[:1]}
    assert nodes == {"abcd": [(0, 2), (1, 1), (2, 0), (2, 5)], "bcde": [(0, 3), (1, 2)], "cdef": [(0, 4), (1, 3)], "xabc": [(0, 1), (2, 4)]}


def test_spans_of_nothing_and_of_own_repeats(spark):
    assert P.shared_spans(records(spark, [])).count() == 0
    assert P.shared_spans(records(spark, ["abc" * 300, None])).count() == 0


@given(st.text(max_size=60), st.integers(1, 12))
@settings(max_examples=60, deadline=None)
def test_window_hashes_agree_with_equality(text, width):
    p = X.code_points(text)
    h = X.window_hashes(p, width)
    assert len(h) == max(0, len(text) - width + 1)
    for i in range(len(h)):
        for j in range(i):
            assert (h[i] == h[j]) == (text[i : i + width] == text[j : j + width])


needs_tokenizer = pytest.mark.skipif(not os.path.exists(os.path.join(T.folder(), f"{E.NAME}.tiktoken")), reason="no tokenizer files")


def odd_texts(n=120, seed=0):
    rng = random.Random(seed)
    parts = ["The sealed ledger of Quirith", " ", "  ", "\n", "\r\n", "\t", " ", "　", "'s", "don't", "…", "安静的地图拒绝了", "。", "フォルダ", "แผนที่", "चिह्न ने", "👩‍🔬", "<|endoftext|>", "é", "é", "12,345.6", "​", "a" * 40, ". ", ", "]
    return ["".join(rng.choice(parts) for _ in range(rng.choice((3, 60, 600)))) for _ in range(n)]


@needs_tokenizer
def test_encoding_equals_whole_encoding(spark):
    texts = odd_texts() + [None, "", " ", "x", odd_texts()[3]]
    shared = " ".join(WORDS * 60)
    texts += [shared, shared + " tail", "head " + shared]
    whole = T.encoder(E.NAME)
    data = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)] + [(5, texts[5], "k")], "doc_id bigint, text string, ids string")
    got = [(r.doc_id, list(r.ids)) for r in E.encode_corpus(data).collect()]
    assert len(got) == len(texts) and dict(got) == {i: whole([t])[0] for i, t in enumerate(texts)}


@needs_tokenizer
@given(st.text(alphabet=st.sampled_from(list("aZé 1\n\t'.,-。中あ ́s")), max_size=200))
@settings(max_examples=150, deadline=None)
def test_any_boundary_is_a_piece_boundary(text):
    whole = T.encoder(E.NAME)
    for c in E.boundaries(X.code_points(text)).tolist():
        assert whole([text[:c]])[0] + whole([text[c:]])[0] == whole([text])[0]


def test_equal_passages_give_equal_chunks():
    rng = random.Random(1)
    passage = " ".join(rng.choice(WORDS) for _ in range(3000))
    chunk = lambda t: {t[a:b] for a, b in zip(E.cut_all([t])[0], E.cut_all([t])[0][1:])}
    a, b = chunk("start one " + passage), chunk("another beginning, longer than the first. " + passage)
    assert len(a & b) > 0.7 * len(a)


@pytest.mark.parametrize("capacity", [10, 64, 500])
def test_packing_holds_every_item_once(spark, capacity):
    rng = random.Random(capacity)
    sizes = [0, 0, None, capacity, capacity + 1, 3 * capacity, 1] + [min(900, int(rng.expovariate(1 / 40)) + 1) for _ in range(900)] + [7] * 400
    got = K.pack(spark.createDataFrame(list(enumerate(sizes)), "doc_id bigint, size bigint"), capacity).toPandas()
    assert set(got.doc_id) == set(range(len(sizes)))
    got["n"] = got.tok_end - got.tok_start
    assert got.groupby("container").n.sum().max() <= capacity
    whole = got.groupby("doc_id").agg(total=("n", "sum"), parts=("n", "size"))
    for i, s in enumerate(sizes):
        assert whole.total[i] == (s or 0) and whole.parts[i] == max(1, -(-(s or 0) // capacity))
    need = -(-sum(s or 0 for s in sizes) // capacity)
    assert got.container.nunique() <= 1.03 * need + 2


def test_packing_of_nothing(spark):
    assert K.pack(spark.createDataFrame([], "doc_id bigint, size bigint"), 10).count() == 0


def test_least_squares_finds_repeats():
    combos = K.combinations(np.array([40, 60, 100]), 100)
    x = K.non_negative_least_squares(combos, np.array([50.0, 50.0, 7.0]))
    repeat = {tuple(sorted(int(i) for i in c if i >= 0)): v for c, v in zip(combos, x)}
    assert repeat[(0, 1)] == pytest.approx(50, abs=0.5) and repeat[(2,)] == pytest.approx(7, abs=0.5)


def corpus():
    rng = random.Random(4)
    names = ["".join(rng.choice(("Vra", "mel", "dor", "qui", "zan", "tek")) for _ in range(3)).title() for _ in range(300)]
    lines = []
    for _ in range(700):
        n = rng.choice(names)
        lines.append(rng.choice((f"The ledger of {n} was sealed.", f"Dr. {n} read the map, cf. p. {rng.randrange(99)} of the draft.", f"Nobody met {n} at 10 a.m. The door was shut.", f"We kept maps, notes, etc. Between them stood {n}.", f"See Fig. {rng.randrange(99)} and No. {rng.randrange(99)} for {n}.", f"She said no. If {n} agrees, we go.", f"It fell to 2.5, i.e. below the mark.", "There is no door with no lock here. If it opens, call.", "The old house stood there alone. The garden was empty.", f"A. B. {n} wrote it down.")))
    return [" ".join(lines[i : i + 7]) for i in range(0, 700, 7)]


@pytest.fixture(scope="module")
def splitter(spark):
    data = spark.createDataFrame([(i, t, None) for i, t in enumerate(corpus())], "doc_id bigint, text string, lang string")
    return S.Splitter(S.fit(data))


@pytest.mark.parametrize(
    "text, units",
    [
        ("Dr. Zaxo read it. The map was shut.", ["Dr. Zaxo read it.", "The map was shut."]),
        ("We met at 10 a.m. The door was shut, cf. p. 5 of it.", ["We met at 10 a.m.", "The door was shut, cf. p. 5 of it."]),
        ("She said no. If so, see No. 5 at 2.5.", ["She said no.", "If so, see No. 5 at 2.5."]),
        ("A. B. Zaxo wrote. “Who did it?” The end!", ["A. B. Zaxo wrote.", "“Who did it?”", "The end!"]),
        ("“It is shut!” said the map. Nobody came.", ["“It is shut!” said the map.", "Nobody came."]),
        ("The map (see § 5; it moved!) was shut.", ["The map (see § 5; it moved!) was shut."]),
        ("# Head\n\n1. One item\n2. Two. The end\n\nWrapped\nline", ["# Head", "1. One item", "2. Two.", "The end", "Wrapped\nline"]),
        ("READER: The map… The end ... and so on.", ["READER: The map…", "The end ... and so on."]),
        ("谁来了？安静的地图。他问：“谁？”我走了。", ["谁来了？", "安静的地图。", "他问：“谁？”", "我走了。"]),
        ("“残差缩短了。什么都没动。”他写道，走了。", ["“残差缩短了。什么都没动。”他写道，走了。"]),
        ("「忘れた。何も動かない。」とリョは書いた。地図は……待っていた。", ["「忘れた。何も動かない。」とリョは書いた。", "地図は……待っていた。"]),
        ("แผนที่ใหม่ ชุมชนแยก Zaxo ในสมุด 2.5 เก่า", ["แผนที่ใหม่", "ชุมชนแยก Zaxo ในสมุด 2.5 เก่า"]),
        ("डॉ. Zaxo ने खोला। शांत रिकॉर्ड है।", ["डॉ. Zaxo ने खोला।", "शांत रिकॉर्ड है।"]),
        ("﻿　 The map.  ", ["The map."]),
        ("", []),
        (" \n\t ", []),
    ],
)
def test_sentence_units(splitter, text, units):
    assert [text[a:b] for a, b in splitter.split(text, "en")] == units


def test_sentences_leave_nothing_out(spark):
    data = spark.createDataFrame([(i, t, "en", 1) for i, t in enumerate([*corpus()[:20], *odd_texts(40), None, "", "x" * 50_000])], "doc_id bigint, text string, lang string, sent_start int")
    texts = {r.doc_id: r.text for r in data.collect()}
    units: dict = {}
    for r in S.sentences(data).collect():
        units.setdefault(r.doc_id, []).append((r.sent_start, r.sent_end))
    for i, t in texts.items():
        covered, last = "", 0
        for a, b in sorted(units.get(i, [])):
            assert last <= a < b <= len(t)
            covered, last = covered + t[a:b], b
        strip = lambda x: "".join(c for c in x if not c.isspace() and c != "﻿")
        assert strip(covered) == strip(t or "")


def test_language_of_long_mixed_blocks():
    thai = "วันนี้อากาศดีมาก เราไปเดินเล่น"
    long = "Read the list of the names " + "abc " * 150 + thai
    units = [long[a:b] for a, b in S.Splitter(S.Model()).split(long, "en")]
    assert units[-1] == "เราไปเดินเล่น" and units[0].endswith("วันนี้อากาศดีมาก")
    assert S.language("東 " + thai * 3, None) == "th"
    assert S.language("東京都庁舎の案内", None) == "ja" and S.language("这是中文句子，引用の字而已", None) == "zh"
    assert S.language("x" * 250 + " der Hund und die Katze sind nicht im Haus", "en") == "de"


def test_sentences_without_a_space_between(splitter):
    text = "The map was shut.The garden was empty. See store/a_1.Npz and 2.5.The door was shut."
    assert [text[a:b] for a, b in splitter.split(text, "en")] == ["The map was shut.", "The garden was empty.", "See store/a_1.Npz and 2.5.", "The door was shut."]
    wide = "x" * 3000 + " cf. " + "y" * 200 + "."
    assert S.Splitter._words(wide, 0, len(wide) - 1)[-1] == "y" * 200


def test_ratio_tells_company_from_chance(spark):
    rows = spark.createDataFrame([(50, 50, 60, 10_000), (1, 100, 100, 10_000), (0, 10, 10, 100)], "a bigint, b bigint, c bigint, d bigint")
    near, chance, apart = (r[0] for r in rows.select(S._ratio(*(F.col(c) for c in "abcd"))).collect())
    assert near > 100 and chance < 1 and apart == 0


def test_sentence_model_keeps_rare_types_of_a_large_vocabulary(spark):
    letters = "bcdfghjklmnpqrstvwxz"
    words = ["".join((letters[i % 20], "a", letters[i // 20 % 20], "o", letters[i // 400 % 20], "u", letters[i // 8000 % 20])) for i in range(101_000)]
    common = [" ".join(f"the the {w}." for w in words[i : i + 1000] for _ in range(5)) for i in range(0, len(words), 1000)]
    rare = ["The map is cf. Zaxo of it.", "It was cf. Zaxo in the map."] * 2
    data = spark.createDataFrame([(i, t, "en") for i, t in enumerate(common + rare)], "doc_id bigint, text string, lang string")
    model = S.fit(data)
    assert any(a == "cf" for _, a in model.short)
    assert ["It is cf. Zaxo of it."] == [t[a:b] for t in ["It is cf. Zaxo of it."] for a, b in S.Splitter(model).split(t, "en")]


def test_scores_of_columns_are_those_of_numbers(spark):
    rows = [(8, 0, 1000, 50, "cf"), (40, 3, 1000, 50, "a.m"), (5, 60, 10, 9, "no"), (9, 0, 0, 0, "word")]
    got = [r[0] for r in spark.createDataFrame(rows, "a bigint, b bigint, c bigint, d bigint, k string").select(S._score("a", "b", "c", "d", "k")).collect()]
    assert got == pytest.approx([S.score(*r) for r in rows])
