"""Core operators against independent brute-force versions, and their edge cases."""

import datetime as dt
import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillstream import session
from quillstream.functions import text as T
from quillstream.functions.times import instant
from quillstream.operators import components as C
from quillstream.operators import discovery as D
from quillstream.operators import experiments as X
from quillstream.operators import review as R
from quillstream.operators import seeds as S
from quillstream.operators import temporal as P
from quillstream.operators.admission import admit
from quillstream.operators.asof import PersistentTree, as_known_at
from quillstream.operators.ranks import salted_rank
from quillstream.plans import review as Q

BASE = dt.datetime(2024, 1, 1)


def at(n):
    return BASE + dt.timedelta(seconds=n)


def test_persistent_tree_keeps_every_version():
    rng = random.Random(1)
    for _ in range(60):
        recs = sorted((rng.randrange(20), rng.randrange(20)) for _ in range(rng.randrange(1, 14)))
        tree = PersistentTree(sorted({v for _, v in recs}))
        for i, (k, v) in enumerate(recs):
            tree.insert(k, v, i)
        for t in range(-1, 22):
            want = max((i for i, (k, v) in enumerate(recs) if k <= t and v <= t), default=-1)
            assert tree.search(t) == want


def asof(spark, events, records, **kw):
    e = spark.createDataFrame(events, "id string, k string, t timestamp, value string")
    r = spark.createDataFrame(records, "k string, known timestamp, valid timestamp, value string, id string")
    out = as_known_at(
        e, r, event_id=F.col("id"), event_key=F.col("k"), event_time=F.col("t"), record_key=F.col("k"), known_at=F.col("known"), valid_from=F.col("valid"), value=F.col("value"), **kw
    )
    return sorted(tuple(x) for x in out.collect())


def brute_asof(events, records):
    out = set()
    for i, k, t, _ in events:
        ok = [(kn, v) for rk, kn, va, v, _ in records if rk is not None and rk == k and kn is not None and t is not None and kn <= t and (va is None or va <= t)]
        if ok and i is not None:
            out.add((i, max(ok)[1]))
    return sorted(out)


def test_as_known_at(spark):
    rng = random.Random(2)
    records = [(rng.choice(["a", "b", None, "hot"]), at(rng.randrange(99)), rng.choice([None, at(rng.randrange(99))]), f"v{i:03}", "x") for i in range(200)]
    records += records[:10] + [("a", None, None, "never", "x")]
    events = [(f"e{i}", rng.choice(["a", "b", "c", None, "hot"]), rng.choice([None, at(rng.randrange(120))]), "clash") for i in range(150)]
    events += events[:5]
    want = brute_asof(events, records)
    assert asof(spark, events, records) == want
    # hot entities: blocks of time and salted events give the same
    assert asof(spark, events, records, block_records=10, salt_events=7) == want
    assert asof(spark, [], records) == [] and asof(spark, events, []) == []


def test_salted_rank(spark):
    df = spark.createDataFrame([(k, i) for i in range(300) for k in ("hot", None) if k or i < 9], "k string, i int")
    got = defaultdict(list)
    for r in salted_rank(df, ["k"], F.col("i"), salts=8).collect():
        got[r["k"]].append(r["rank"])
    assert sorted(got["hot"]) == list(range(300)) and sorted(got[None]) == list(range(9))


def test_instants(spark):
    values = ["2024-01-01T09:00:00+09:00", "2024-01-01T00:00:00Z", "2024-01-01T00:00:00", "2024-01-01", "", None, "x", "2024-13-01T00:00:00Z"]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "s string").select(F.unix_micros(instant("s"))).collect()]
    assert got[0] == got[1] == 1704067200000000 and got[2:] == [None] * 6


@pytest.mark.parametrize("text, tags", [("#하나 #둘", ["하나", "둘"]), ("가#아님 #예", ["예"]), ("https://a.b/#x #y", ["y"]), ("", []), ("a@b.com #z", ["z"])])
def test_hashtags(spark, text, tags):
    assert spark.createDataFrame([(text,)], "s string").select(T.hashtags(F.col("s"))).first()[0] == tags


def test_phrases_match_a_loop(spark):
    def loop(seg, most):
        w, out = seg.split(), set()
        for n in range(2, min(most, len(w)) + 1):
            grams = [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]
            out |= {p for p in grams if any("가" <= c <= "힣" for c in p)}
        return out | {x for x in w if len(x) >= 3 and all("가" <= c <= "힣" for c in x)}

    segs = ["오늘도 출석 abc", "a b c", "하나", "세글자", "가 나 가 나 가", ""]
    df = spark.createDataFrame([(s,) for s in segs], "s string").select("s", T.phrases(F.col("s"), 4).alias("p"))
    for r in df.collect():
        assert set(r["p"]) == loop(r["s"], 4) and len(r["p"]) == len(set(r["p"]))


OBS = "input_line long, observation_id string, platform string, source_id string, video_id string, channel_id string, modality string, kind string, text string, context struct<channel_label:string,video_title:string,video_description:string>, posted_at string, updated_at string, collected_at string, available_at string, provenance string"


def obs(line, oid, text="글 하나", **kw):
    r = dict(input_line=line, observation_id=oid, platform="youtube", source_id=f"s{line}", video_id=f"v{line}", channel_id=f"c{line}", modality="title", kind=None, text=text, context=None,
             posted_at="2024-01-01T00:00:00Z", updated_at=None, collected_at="2024-01-02T00:00:00Z", available_at="2024-01-02T00:00:00Z", provenance="actual_collected")
    r.update(kw)
    return tuple(r.values())


def reasons(spark, rows, cutoff="2024-02-01T00:00:00Z"):
    return {r["input_line"]: r["reason"] for r in admit(spark.createDataFrame(rows, OBS), cutoff).collect()}


def test_admission_ladder(spark):
    same = dict(source_id="s", video_id="v", channel_id="c")
    got = reasons(spark, [
        obs(1, "a"), obs(2, None), obs(3, " "), obs(4, "b", platform="other"), obs(5, "c", posted_at="2024-01-01T00:00:00"), obs(6, "d", collected_at="2025-01-01T00:00:00Z"),
        obs(7, "e", posted_at="2024-01-03T00:00:00Z"), obs(8, "f", text="!!!"), obs(9, "g", provenance=None), obs(10, "dup", **same), obs(11, "dup", **same),
        obs(12, "con", text="x 1"), obs(13, "con", text="y 2"), obs(14, "n1", source_id="z"), obs(15, "n2", source_id="z", collected_at="2024-01-03T00:00:00Z"), obs(16, "h", updated_at="bad"),
    ])
    assert got == {
        1: None, 2: "missing_or_invalid_observation_id", 3: "missing_or_invalid_observation_id", 4: "unsupported_platform", 5: "missing_or_invalid_posted_at", 6: "collected_at_after_cutoff",
        7: "posted_after_collection", 8: "empty_tokenized_text", 9: "missing_or_invalid_provenance", 10: None, 11: "duplicate_observation", 12: "conflicting_observation_id",
        13: "conflicting_observation_id", 14: "superseded_source_snapshot", 15: None, 16: "invalid_updated_at",
    }
    assert reasons(spark, []) == {}


def detect(spark, rows, **kw):
    ok = admit(spark.createDataFrame(rows, OBS), "2024-02-01T00:00:00Z").where("reason is null")
    return [r.asDict() for r in D.detect(ok, **kw).collect()]


def test_documents_count_once_and_one_video_is_no_candidate(spark):
    two = [obs(1, "a", "오늘도 무사 퇴근"), obs(2, "b", "오늘도 무사 퇴근")]
    got = detect(spark, two)
    assert len(got) == 1 and got[0]["source_document_frequency"] == 2 and got[0]["distinct_observed_content_count"] == 1
    assert detect(spark, [obs(i, f"o{i}", "같은 영상 댓글", video_id="v", modality="comment") for i in range(1, 6)]) == []


def test_variants_link_only_with_d1(spark):
    rows = [obs(1, "a", "오늘도 무사히 집에 간다"), obs(2, "b", "오늘도 무사히 집에 온다")]
    d1 = detect(spark, rows, method="D1")
    assert any(r["possible_variant_edge_count"] > 0 and r["source_document_frequency"] == 2 for r in d1)
    assert not any(r["surface_form_count"] > 1 for r in detect(spark, rows))


def test_repeated_description_lines_are_boilerplate(spark):
    rows = [obs(i, f"o{i}", f"채널 구독은 사랑입니다\n별개 내용 {w}", modality="description", channel_id="c") for i, w in ((1, "하나둘셋"), (2, "넷다섯"), (3, "여섯"))]
    lines = D.line_reasons(D.text_lines(admit(spark.createDataFrame(rows, OBS), "2024-02-01T00:00:00Z")))
    assert {(r["line_number"], r["suppressed"]) for r in lines.collect()} == {(1, "same_channel_repeated_description_line"), (2, None)}


def test_maximal_matches_the_greedy_definition(spark):
    rng = random.Random(3)
    rows, groups = [], defaultdict(list)
    for g in range(20):
        for _ in range(8):
            p = " ".join(rng.choice("가 나 다".split()) for _ in range(rng.randrange(1, 5)))
            if (g, p) not in {(a, b) for a, _, b in [(x[2], 0, x[0]) for x in rows]}:
                prot = rng.random() < 0.2
                rows.append((p, prot, g))
                groups[g].append((p, prot))
    want = set()
    for g, items in groups.items():
        taken = []
        for p, prot in sorted(items, key=lambda x: (-len(x[0].split()), -len(x[0]), x[0])):
            if prot or not any(f" {p} " in f" {q} " for q in taken):
                taken.append(p)
                want.add((g, p))
    df = spark.createDataFrame([(p, prot, str(g)) for p, prot, g in rows], "phrase string, protected boolean, signature string")
    assert {(int(r["signature"]), r["phrase"]) for r in D.maximal(df).collect()} == want


def test_components_and_fixpoints(spark):
    rng = random.Random(4)
    edges = [(str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(45)] + [("hub", str(i)) for i in range(10)] + [(None, "1")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in C.connected(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {n: find(n) for n in parent}
    dag = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("c", "a")], "parent string, child string")
    start = spark.createDataFrame([("a",), ("z",)], "node string")
    assert {r[0] for r in C.reachable(dag, start).collect()} == {"a", "b", "c", "z"}
    nodes = spark.createDataFrame([("y",), ("b",), ("c",), ("a",), ("q",)], "node string")
    assert {r[0] for r in C.closed_under_parents(nodes, dag).collect()} == {"a", "b", "c", "q"}
    assert C.connected(spark.createDataFrame([], "a string, b string")).count() == 0


def test_snapshot_is_as_of(spark):
    rows = spark.createDataFrame(
        [("m", "1", "2024-01-01T00:00:00Z", None, 1), ("m", "2", "2024-01-03T00:00:00Z", None, 2), ("m", "9", "2024-01-02T00:00:00Z", "2025-01-01T00:00:00Z", 3), ("m", "1b", "2024-01-01T00:00:00Z", None, 0)],
        "k string, version string, available_at string, published_at string, n long",
    )
    assert [r["version"] for r in P.latest_as_of(rows, F.col("k"), "2024-01-02T12:00:00Z", F.col("n")).collect()] == ["1b"]


def test_partition_conflicts_and_exposure(spark):
    nodes = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", None), ("d", "dev")], "node string, wanted string")
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("d", "y"), ("c", "y")], "a string, b string")
    got = {r["node"]: (r["split"], r["conflict"]) for r in P.partition_groups(nodes, edges, [("train", 1.0)], "s").collect()}
    assert got == {"a": (None, True), "b": (None, True), "c": ("dev", False), "d": ("dev", False)}
    shape = "entity string, example_id string, brief_sha string, target_sha string"
    cur = spark.createDataFrame([("m", "1", "p", "q"), ("m", "2", "p", "z"), ("n", "3", None, "q")], shape)
    prior = spark.createDataFrame([("m", "2", "a", "b"), ("k", "7", "p", "q"), ("k", "8", None, "q")], shape)
    assert {tuple(r) for r in P.exposure_conflicts(cur, prior).collect()} == {("1", "same_content"), ("2", "same_example_identity")}


def test_ratings_weigh_families_alike_and_bootstrap_brackets_the_mean(spark):
    shape = "lineage string, family string, scenario string, condition string, value double"
    rows = [("l1", "f1", "s", "A", 1.0), ("l1", "f1", "s", "B", 3.0), ("l1", "f2", "s", "A", 2.0), ("l1", "f2", "s", "B", 2.0), ("l2", "f3", "s", "A", 1.0), ("l2", "f3", "s", "B", 3.0), ("l2", "f4", "s", "C", 5.0)]
    diff = X.paired_difference(spark.createDataFrame(rows, shape), "A", "B")
    out = X.cluster_bootstrap(diff, 200, 1).first()
    assert out["families"] == 3 and out["clusters"] == 2 and abs(out["mean"] - 4 / 3) < 1e-9 and out["low"] <= out["mean"] <= out["high"]
    assert X.cluster_bootstrap(diff.where("lineage = 'l1'"), 50, 1).first()["low"] is None


def test_retrieval_matches_a_loop(spark):
    import math
    from collections import Counter

    pool = [("e1", "g", "the cat sat"), ("e2", "g", "the dog ran"), ("e3", "g", "a cat ran"), ("e4", "h", "the cat sat")]
    q = "the cat ran"

    def bag(t):
        t = "".join(t.lower().split())
        return Counter(t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1))

    docs = {i: bag(t) for i, g, t in pool if g == "g"}
    df = Counter(x for b in docs.values() for x in b)
    w = lambda b: {x: (1 + math.log(c)) * (math.log((1 + 3) / (1 + df[x])) + 1) for x, c in b.items()}
    wq = w(bag(q))
    want = {}
    for i, b in docs.items():
        wd = w(b)
        want[i] = sum(wq[x] * wd.get(x, 0) for x in wq) / math.sqrt(sum(v * v for v in wq.values())) / math.sqrt(sum(v * v for v in wd.values()))
    out = X.tfidf_retrieve(spark.createDataFrame([("q", "g", q)], "query_id string, grp string, text string"), spark.createDataFrame(pool, "example_id string, grp string, text string"), 2).collect()
    assert [r["example_id"] for r in sorted(out, key=lambda r: r["rank"])] == sorted(want, key=lambda i: -want[i])[:2]
    assert all(abs(r["score"] - want[r["example_id"]]) < 1e-9 for r in out)


CARD = "card_id long, video_id string, channel_id string, title string, description string, posted_at string, available_at string, search_rank int"


def card(n, title, channel="c", description="", video=None):
    return (n, video or f"{n:011}", channel, title, description, "2024-01-01T00:00:00Z", "2024-01-02T00:00:00Z", n)


def test_seeds_followups_and_families(spark):
    rows = [card(1, '그가 "오늘도 무사 퇴근" 패러디'), card(2, "오늘도 무사 퇴근 밈", "d"), card(3, "오늘도 무사 퇴근 또", "e"), card(4, "오늘도 무사 퇴근 또", "f"), card(5, "[속보] 오늘도 무사 퇴근", "g"), card(6, "제목 없음"), card(7, None)]
    videos = S.unique_videos(spark.createDataFrame(rows, CARD), "card_id").cache()
    seeds = S.plan_seeds(videos, 10).cache()
    quoted = {r["query"]: r for r in seeds.collect()}["오늘도 무사 퇴근"]
    assert quoted["kind"] == "quoted_expression" and quoted["score"] == 7
    picks = [r["video_id"] for r in S.followups(seeds.where("query = '오늘도 무사 퇴근'"), videos, 3).orderBy("place").collect()]
    assert picks[0] == f"{2:011}" and len(picks) == 2  # same title once, news left out
    fam = {r["label"]: r for r in S.families(seeds, videos).collect()}["오늘도 무사 퇴근"]
    assert fam["status"] == "supported_textual_reuse" and fam["channels"] >= 2


def test_families_of_frames_and_catchphrases_and_what_is_rejected(spark):
    rows = [
        card(1, "아주 진지한 고양이는 강아지와 구분할 수 없다", "a"), card(2, "아주 진지한 수달은 너구리와 구별할 수 없다", "b"), card(3, "가자가자 가자가자 바다로 떠나는 가자가자", "a"), card(4, "가자가자 가자가자 산으로 떠나는 가자가자", "b"),
        card(5, "[속보] 정부 발표", "c"), card(6, "아무것도 아닌 제목", "d"),
    ]
    videos = S.unique_videos(spark.createDataFrame(rows, CARD), "card_id").cache()
    seeds = S.plan_seeds(videos, 10).cache()
    kinds = {(r["kind"], r["status"], r["variants"]) for r in S.families(seeds, videos).collect()}
    assert {("sentence_comparison", "supported_textual_reuse", 2), ("repeated_catchphrase", "supported_textual_reuse", 2)} <= kinds
    got = {(r["item"], r["reason"]) for r in S.rejected(seeds, videos).collect()}
    assert (f"{5:011}", "news_or_topic_title_without_reuse_evidence") in got and (f"{6:011}", "no_supported_reusable_form_detected") in got
    frame = videos.where("card_id = 3").select(T.repeated_frame(F.col("title"), F.lit("가자가자 가자가자")).alias("f")).first()[0]
    assert frame["middle"] == "바다로 떠나는" and frame["token"] == "가자가자"


def test_comparison_frame(spark):
    df = spark.createDataFrame([("아주 진지한 고양이는 강아지와 구분할 수 없다",), ("고양이는 강아지와 구분할 수 없다",), ("그냥 제목",)], "t string")
    got = [r[0] for r in df.select(S.comparison_frame(F.col("t"))).collect()]
    assert got[0]["prefix"] == "아주 진지한" and got[0]["left"] == "고양이" and got[0]["right"] == "강아지" and got[1:] == [None, None]


def test_title_variations_match_all_pairs(spark):
    rows = []
    for n in range(420):
        a, b, c = f"고양이{n % 7}", ("리모컨 숨겼다", "물총 숨겼다 몰래", "냄비 안에 앉았다")[n % 3], f"{n % 5}화"
        title = f"세상에서 제일 느린 {a} {b} {c}" if n % 4 else f"{b} 혼자 남은 {a} 어느 날 {c} {b}"
        rows.append((n, f"v{n // 2}", title))
    df = spark.createDataFrame([*rows, (900, "v900", None), (901, None, rows[1][2])], "id long, video_id string, title string")
    normal = {r["id"]: r["t"] for r in df.select("id", T.normalized(T.core_title(F.col("title"))).alias("t")).collect()}
    want = {}
    for i, v, _ in rows:
        for j, w, _ in rows:
            if i < j and v != w and (f := R.shared_clause(normal[i], normal[j])):
                want[i, j] = (f[0], len(f[1]))
    got = R.title_variations(df).collect()
    assert len(got) == len(want) and {(r["left"], r["right"]): (r["frame"], r["changes"]) for r in got} == want
    assert any(i > 200 for i, _ in want)


def test_title_variations_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(R, "HOT", 7)
    rng = random.Random(8)
    pick = lambda n: " ".join(rng.choice("하나 둘 셋 넷 다섯 둘 셋".split()) for _ in range(n))
    titles = [pick(rng.randrange(4, 9)) for _ in range(80)] + ["세상 모든 것 고양이 이야기"] * 30 + ["세상 모든 것 강아지 이야기"] * 20 + ["세상 모든 고양이 이야기 하나 둘 셋 넷 다섯 " * 4]
    rows = [(f"t{rng.randrange(150):03}", rng.choice([None, "v1", f"v{n}"]), t) for n, t in enumerate(titles)]
    normal = {t: t.strip() for t in titles}
    want = {
        (i, j, f[0], len(f[1])) for i, v, s in rows for j, w, t in rows
        if i < j and v and w and v != w and (f := R.shared_clause(normal[s], normal[t]))
    }
    got = [tuple(r) for r in R.title_variations(spark.createDataFrame(rows, "id string, video_id string, title string")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 200
    assert R.title_variations(spark.createDataFrame([], "id string, video_id string, title string")).count() == 0


def test_one_pattern_of_equal_words_is_compared_once(monkeypatch):
    titles = sorted(f"세상에서 제일 느린 고양이{n} 숨겼다 {n % 9}화" for n in range(300))
    batch = pa.RecordBatch.from_pydict({"three": ["세상에서 제일 느린"] * 300, "i": [0] * 300, "j": [0] * 300, "part": [0] * 300, "t": titles, "ids": [[n] for n in range(300)], "videos": [[f"v{n}"] for n in range(300)]})
    calls, common = [], R._common
    monkeypatch.setattr(R, "_common", lambda a, b: calls.append(1) or common(a, b))
    got = {(r["left"], r["right"]): (r["frame"], r["changes"]) for b in R._Cells().run(iter([batch.slice(0, 130), batch.slice(130)])) for r in b.to_pylist()}
    assert len(calls) <= 8
    assert got == {(i, j): (f[0], len(f[1])) for i in range(300) for j in range(i + 1, 300) if (f := R.shared_clause(titles[i], titles[j]))}


def test_lookup_uses_every_family_and_comparison_frames(spark, tmp_path):
    words = [f"낱말{chr(0xAC00 + n)}" for n in range(80)]
    titles = [f"{w} 모두가 웃었다 {n}" for w in words for n in range(3)] + ["아주 진지한 고양이는 강아지와 구분할 수 없다"]
    rows = [card(n, t, f"c{n % 3}") for n, t in enumerate(titles)]
    spark.createDataFrame(rows, CARD).write.parquet(f"{tmp_path}/video_cards.parquet")
    texts = [f"어제 {w} 모두가 웃었다 {n} 했다" for n, w in enumerate(words)] + ["아주 진지한 수달은 너구리와 구분할 수 없다", "아무것도 아닌 글", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.op_identify(spark, str(tmp_path)).collect()
    assert {r["text_id"] for r in got if r["match_type"] == "exact_observed_expression"} == set(range(80))
    assert {r["text_id"] for r in got if r["match_type"] == "shared_observed_sentence_frame"} == {80}


def test_lookup_matches_a_loop(spark):
    rng = random.Random(6)
    make = lambda a, b: "".join(rng.choice("abA ") for _ in range(rng.randrange(a, b)))
    texts, families = [(n, make(0, 60)) for n in range(120)], [(f"f{n}", make(1, 12), "literal", "2024-01-01T00:00:00Z") for n in range(300)]
    got = R.identify(spark.createDataFrame(texts, "text_id long, text string"), spark.createDataFrame(families, "family_id string, label string, kind string, available_at string"), "2024-06-01T00:00:00Z").collect()
    assert {(r["text_id"], r["family_id"]) for r in got} == {(i, f) for i, t in texts for f, x, *_ in families if len(x) >= 3 and x.lower() in t.lower()}


def test_texts_are_never_broadcast_against_phrases(spark, monkeypatch):
    texts = [(n, t) for n, t in enumerate(["ab cd ef", "cd ef", "", None, "ab cdx ef", "ef"])]
    phrases = [(w, n) for n, w in enumerate(["cd ef", "ab", "ef", "", None, *(f"w{k} v" for k in range(2000))])]
    left, right = spark.createDataFrame(texts, "id long, t string"), spark.createDataFrame(phrases, "p string, k int")
    want = {(i, p) for i, t in texts for p, _ in phrases if t and p and f" {p} " in f" {t} "}
    for most, side in ((session.BROADCAST_BYTES, "BuildRight"), (0, "SortMergeJoin")):
        monkeypatch.setattr(session, "BROADCAST_BYTES", most)
        held = T.containing(left, right, "t", "p")
        plan = held._jdf.queryExecution().executedPlan().toString()
        assert side in plan and "BuildLeft" not in plan
        assert sorted((r["id"], r["p"]) for r in held.collect()) == sorted(want)
