"""Operators on single texts and pairs of strings: against brute force, exact round trips and held-out accuracy."""

import os
import pickle
import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.llm import encode as E
from quillstream.llm import garbled as G
from quillstream.llm import language as L
from quillstream.llm import looks, responses
from quillstream.llm.hdlang import Profiles, plain, segments
from quillstream.llm.strings import common_subsequence, edit_distance, letters

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def naive_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i] + [0] * len(b), row
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return row[-1]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row[:]
        for j, y in enumerate(b, 1):
            row[j] = last[j - 1] + 1 if x == y else max(last[j], row[j - 1])
    return row[-1]


@given(st.text("abc가", max_size=14), st.text("abc가", max_size=14), st.integers(0, 14))
@settings(max_examples=300, deadline=None)
def test_distances(a, b, most):
    d = naive_distance(a, b)
    assert edit_distance(a, b, most) == (d if d <= most else most + 1)
    assert common_subsequence(a, b) == naive_lcs(a, b)


def test_letters():
    assert letters("Ｈéllo, ｗ 1️⃣ ☕​") == "héllow1" and letters("") == letters("!?😂") == ""


@pytest.mark.parametrize("a, b", [("Ｄａｎｓ 7", "Dans 7"), ("학교", unicodedata.normalize("NFD", "학교")), ("café", "café"), ("a​b﻿", "ab"), ("a b　c", "a b c"), ("pаypаl", "paypal"), ("Τest", "Test"), ("エレ工", "工レエ"), ("ｶﾞ", "ガ"), ("하​ᆫ", "한"), ("ﬁn", "fin")])
def test_same_look(a, b):
    assert looks.canonical(a, False) == looks.canonical(b, False) and looks.canonical(a) == looks.canonical(b)


@pytest.mark.parametrize("a, b", [("A", "a"), ("e", "é"), ("5", "⑤"), ("2", "²"), ("hi!", "hi"), ("た", "だ"), ("и", "й"), ("이", "의"), ("👨‍👩‍👧", "👨👩👧")])
def test_different_look(a, b):
    assert looks.canonical(a, False) != looks.canonical(b, False)


def test_same_look_pairs(spark):
    rows = [(1, "v", "Ab", "", 0), (2, "v", "Аb", None, 0), (3, "v", "Ab", "x", 0), (4, "v", "ab", "ｘ", 0), (5, "w", "Аb", "x", 0), (6, None, "Ab", "x", 0), (2, "v", "Аb", None, 1)]
    df = spark.createDataFrame(rows, "card_id long, video_id string, title string, description string, look int")
    got = {tuple(r) for r in looks.same_look_pairs(df, "card_id", "video_id", ["title", "description"]).collect()}
    assert got == {(1, 2, "title"), (2, 3, "title"), (3, 4, "description")}
    assert looks.same_look_pairs(df.where("false"), "card_id", "video_id", ["title"]).count() == 0


@pytest.fixture(scope="module")
def samples(spark):
    return [(r["lang"], r["text"]) for r in spark.read.parquet(f"{DATA}/language_samples.parquet").orderBy("sample_id").collect()]


@needs_data
def test_languages_held_out(samples):
    train, held = samples[::2] + samples[1::4], samples[3::4]
    got, conf = Profiles(train).classify([plain(t) for _, t in held])
    assert sum(a == lang for a, (lang, _) in zip(got, held)) / len(held) >= 0.97 and ((0 <= conf) & (conf <= 1)).all()


def test_segments_leave_out_links_tags_and_credits():
    assert segments("Hello there. More text!\n#tag https://a.b/c\nBGM: Someone\nThanks to X") == ["Hello there.", "More text!"]
    assert segments("") == segments("123 😂") == []


@pytest.mark.parametrize("text, kept", [
    ("BGM: Ryoskeryo / Mientras los comentarios enloquecieron, el gato huyó", ["/ Mientras los comentarios enloquecieron, el gato huyó"]),
    ("Edit by Ipiwezhokul In clip 67, Tamdraponho says that", ["In clip 67, Tamdraponho says that"]),
    ("feat. Ryoquavel 猫が笑った。犬が走った。", ["猫が笑った。", "犬が走った。"]),
    ("고양이가 숨었다 ft. Ryovelkul | The cat hid.", ["고양이가 숨었다", "The cat hid."]),
    ("A cat (music: Some One) ran. It hid.", ["A cat ( ) ran.", "It hid."]),
    ("Edited by Anna Maria Smith", []), ("Thanks to Foo. Then we left.", ["Then we left."]),
    ("A new feature and product.", ["A new feature and product."]),
])
def test_text_after_a_credit_stays(text, kept):
    assert segments(text) == kept


@needs_data
def test_relabelled(spark, samples):
    by = {}
    for lang, t in samples:
        if t[-1] in ".。":
            by.setdefault(lang, []).append(t)
    rows = [(1, by["ko"][0], None, "ko", "x"), (2, by["ko"][0], by["en"][0], "ko-KR", "x"), (3, by["fr"][0], "", "deu", "x"), (4, by["ru"][0], None, None, "x"), (5, None, "", "ko", "x"), (6, "!!", "😂", "", "x"), (7, by["ja"][0], by["ja"][1] * 50, " ", "x"), (8, by["es"][0], None, "spa", "x")]
    df = spark.createDataFrame(rows, "card_id long, title string, description string, default_language string, lang string")
    got = {(r["id"], r["lang"]) for r in L.relabelled(df, Profiles(samples), "card_id", ["title", "description"], "default_language").collect()}
    assert got == {(2, "ko"), (2, "en"), (3, "fr"), (4, "ru"), (7, "ja")}


SCENE = "오늘 아침 주차장에서 반장이 리모컨을 자랑하다가 들켰다. 비 오는 저녁 옥상에서 고양이가 색종이를 반으로 접어 버렸다."


@needs_data
def test_defects(spark, samples):
    own = "쿠둥밍이 올린 12번째 영상에서는 수달이 물총을 조용히 숨겨 두었다."
    cases = [
        ("a", "(없음)", "empty"), ("b", None, "empty"), ("c", " ​", "empty"), ("d", "질문: " + SCENE, "copy"), ("e", SCENE.upper().replace(".", "!"), "copy"), ("f", "> 죄송하지만 그 요청은 도와드릴 수 없습니다.", "refusal"),
        ("g", "요청하신 물총 장면의 자막은 만들어 드리지 않겠습니다. 양해 부탁드립니다.", "refusal"), ("h", "While nobody stopped the music, Juveldra watched it 12 times in the kitchen.", "other_language"),
        ("i", own + " 배경 음악은 더 빨라졌고 띠뭉", "truncated"), ("j", own + " #일상 😂", None), ("k", "도와드릴 수 있는 건 박수뿐이다, 찌뭉루솜.", None), ("l", SCENE.split(". ")[0] + ". " + own + " " + own, None),
    ]
    rows = [(i, SCENE + " 담담한 말투로 써 줘.", o, "clash") for i, o, _ in cases]
    rows += [("m", SCENE + " 답은 영어로 써 줘.", "While nobody stopped the music, Juveldra watched it 12 times in the kitchen.", "x"), ("a", SCENE + " 담담한 말투로 써 줘.", "(없음)", "x"), (None, "p", "", "x"), ("n", None, own, "x")]
    df = spark.createDataFrame(rows, "response_id string, prompt string, output string, defect string")
    got = {r["response_id"]: r["defect"] for r in responses.judge(df, Profiles(samples)).collect()}
    assert got == {i: d for i, _, d in cases if d}
    assert responses.judge(df.where("false"), Profiles(samples)).count() == 0


@needs_data
def test_garbled_round_trips(samples):
    model = G.Garbles(samples[::2])
    held = [t for _, t in samples[1::2] if not t.isascii()]
    assert sum(bool(model.find(t)) for t in held) <= 2
    for true, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp437")):
        made = [(t, G.garble(t, (true, read, 1))) for t in held]
        back = [(t, model.find(g), g) for t, g in made if g]
        fixed = sum("".join(_apply(g, found)) == t for t, found, g in back)
        assert fixed >= 0.9 * len(back), (true, read, fixed, len(back))
    ko = [t for lang, t in samples[1::2] if lang == "ko"]
    assert all(model.find(G.garble(t, ("cp949", "latin-1", 1))) for t in ko)
    for clean in ("£5 (ง •̀_•́)ง 25 °C Ã la carte", "Ça", "草", "", "plain"):
        assert not model.find(clean)


def _apply(text, found):
    at = 0
    for a, b, _, fixed in found:
        yield text[at:a]
        yield fixed if fixed is not None else text[a:b]
        at = b
    yield text[at:]


@needs_data
def test_repair_edge_rows(spark, samples):
    bad = G.garble(samples[5][1] if not samples[5][1].isascii() else "é così", ("utf-8", "cp1252", 1)) or "Ã©"
    df = spark.createDataFrame([(1, bad, 0), (1, bad, 0), (2, None, 0), (3, "", 0), (4, "plain", 0), (5, ("긴 글 " * 5000) + "cafÃ© olÃ©", 0)], "doc_id long, text string, complete int")
    got = sorted(r["doc_id"] for r in G.repair(df, G.Garbles(samples)).collect())
    assert got == [1, 1, 5]


needs_vocabulary = pytest.mark.skipif(not os.path.exists(E.vocabulary_path()), reason="no vocabulary files")


@needs_vocabulary
def test_encoding_equals_the_public_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(E.vocabulary_path())
    t.encode_special_tokens = True
    rng = random.Random(5)
    texts = ["".join(rng.choice(" aabcst\n\t'12é한글日本😂<|endoftext|>!") for _ in range(rng.randrange(60))) for _ in range(400)] + ["<|endoftext|>", "a" * 5000, " " * 99, "'s 'll"]
    assert E.Replay(E.vocabulary_path()).texts(texts) == [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "hi", 1), (3, "hi", 1)], "doc_id long, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in E.encode(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, t.encode("hi").ids), (3, t.encode("hi").ids)]
    assert [r[0] for r in df.orderBy("doc_id").select(E.token_counts(F.col("text"))).collect()][:2] == [0, 0]


def test_cosines_are_those_of_the_bundles():
    samples = [("en", "the cat sat on the mat and the dog ran"), ("de", "die Katze sitzt auf der Matte und der Hund lief"), ("ko", "고양이가 매트 위에 앉았고 강아지는 달렸다")]
    p = Profiles(samples * 3)
    texts = ["the dog sat on the dog", "der Hund auf der Matte", "강아지가 앉았다 앉았다", ""]
    got = p._cosines(texts)
    for text, row in zip(texts[:3], got):
        v = p.bundle(text)
        assert np.abs(row - p.prototypes @ v / np.linalg.norm(v)).max() < 0.1
    assert not got[3].any()


def test_every_segment_is_bundled_and_compared_by_its_own_cosine():
    samples = [("en", "the cat sat on the mat and the dog ran"), ("de", "die Katze sitzt auf der Matte und der Hund lief"), ("ko", "고양이가 매트 위에 앉았고 강아지는 달렸다")]
    p = Profiles(samples * 3)
    texts = ["강아지는 달렸다 고양이가 앉았고 달렸다", "the dog sat on the dog and ran", "매트 위에 앉았고 the mat", "the dog sat on the dog and ran", "123", "강아지는 달렸다 고양이가 앉았고 달렸다" * 40]
    for each in (p, pickle.loads(pickle.dumps(p))):
        got = each.cosines(texts)
        for text, row in zip(texts, got):
            if text != "123":
                v = p.bundle(text)
                assert np.abs(row - p.prototypes @ v / np.linalg.norm(v)).max() < 1e-5
    assert 0 < got[0].max() < 0.999 and not got[4].any()


def test_refusals_are_aligned_with_templates_not_listed():
    r = responses.Refusals(responses.refusal_templates())
    declining = [
        "I'm afraid I cannot create content of this kind.", "Sorry, but I won’t be able to provide an answer to your question.", "My apologies. I am not able to complete this request as asked.",
        "저는 이런 종류의 글은 작성해 드릴 수 없습니다.", "죄송합니다. 요청하신 내용에는 답변드리기 어렵습니다.", "유감스럽지만 해당 작업은 수행할 수가 없습니다.",
        "恐れ入りますが、この件については回答できません。", "大変申し訳ございませんが、ご要望の文章は提供いたしかねます。", "很抱歉，我无法为您撰写这段内容。",
        "Lo siento, no puedo ayudar con esa solicitud.", "Désolé, je ne peux pas répondre à cette demande.", "Es tut mir leid, das kann ich nicht schreiben.", "Maaf, saya tidak dapat membantu permintaan itu.",
        "Sure. Well, on reflection I must decline.",
    ]
    plainly = [
        "I can't help laughing at the school band.", "웃지 않을 수 없는 지나치게 솔직한 하루.", "고양이가 프라이팬을 공중에 던졌다가 놓쳤다.", "Nobody could help the penguin find the sock.",
        "He said that the baker cannot write, and everyone held their breath while the band played on.", "猫がドミノを抱きしめて眠った。", "", "ok",
    ]
    assert [x for x in declining if not r.match(x)] == [] and [x for x in plainly if r.match(x)] == []


def test_an_output_is_truncated_by_itself():
    whole = ["고양이가 잠들었다. #일상", "끝났습니다", "고양이가 잠들었다", "A cat slept! 😂", "", "#tag", "よかったです"]
    cut = ["고양이가 잠들었다. 강아지가 프라", "While the cat", "복도 끝에서 873번이나 다", "A cat slept. Then the do \""]
    assert not any(map(responses.stops_within, whole)) and all(map(responses.stops_within, cut))
