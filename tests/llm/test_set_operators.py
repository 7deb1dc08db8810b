"""Operators on whole tables against brute force on small fixtures."""

import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstream.llm import anchors, groups, history, overlap, pack
from quillstream.llm.history import within
from quillstream.llm.strings import edit_distance, letters

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
WORDS = "고양이 강아지 수달 리모컨 물총 화분 옥상 부엌 지하철 조용히 몰래 숨겼다 던졌다 노래했다 the cat found a giant balloon near kitchen while nobody stopped".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(100)) for _ in range(n))


def damage(rng, text, share):
    chars = list(text)
    for _ in range(int(share * len(text))):
        i = rng.randrange(len(chars))
        chars[i : i + 1] = rng.choice([[], [chars[i]] * 2, ["가"], [chars[i].upper()]])
    return "".join(chars)


def brute_repeats(rows):
    accepted, ids, out = [], {}, {}
    for line, _, oid, text in sorted(rows, key=lambda r: r[0]):
        best = None
        f = letters(text or "")
        if oid is not None and text and (oid, text) in ids:
            best = ids[oid, text]
        if len(f) >= history.LEAST_LETTERS:
            for n, g in accepted:
                if (best is None or n < best) and within(f, g):
                    best = n
        if best is None:
            if len(f) >= history.LEAST_LETTERS:
                accepted.append((line, f))
            if oid is not None and text:
                ids[oid, text] = line
        else:
            out[line] = best
    return out


def repeats(spark, rows):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "input_line long, batch_id int, observation_id string, text string, line string")
    got = history.repeated_rows(df).collect()
    assert len(got) == len({r["line"] for r in got})
    return {r["line"]: r["repeated_line"] for r in got}


def test_repeated_rows_match_brute_force(spark):
    rng = random.Random(1)
    rows, texts = [], []
    hot = sentence(rng, 16)
    for n in range(260):
        kind = rng.random()
        if kind < 0.33:
            text = damage(rng, hot, rng.choice([0, 0, 0.02, 0.05]))
        elif kind < 0.6 and texts:
            text = damage(rng, rng.choice(texts), rng.choice([0, 0.03, 0.07]))
        elif kind < 0.7:
            text = rng.choice(["짧은 글", "", None, "ok"])
        else:
            text = sentence(rng, rng.randrange(9, 30))
        if text and len(text) > 60:
            texts.append(text)
        rows.append((n, n // 40, rng.choice([None, "id1", f"o{n}"]), text))
    got, want = repeats(spark, rows), brute_repeats(rows)
    # letters damaged evenly up to the very limit may leave no match long enough: at most one row in a hundred
    wrong = {k for k in {*got, *want} if got.get(k) != want.get(k)}
    assert len(wrong) <= 0.01 * len(want) and len(want) > 100


def test_long_and_repetitive_texts_are_within_reach(spark):
    rng = random.Random(11)
    thread = letters(sentence(rng, 1500))
    chant = "오레오레오" * 60
    for text in (thread, chant, "가" * 50):
        for share in (0, 0.01, 0.06, 0.12, 0.2):
            other = letters(damage(rng, text, share))
            n = max(len(text), len(other))
            assert within(text, other) == (edit_distance(text, other, n) <= int(history.DIFFER * n))
    assert within(chant, chant[:100] + "나" + chant[101:])
    assert repeats(spark, [(1, 0, "a", thread), (2, 0, "b", thread[:4000] + "끝" + thread[4000:]), (3, 1, "c", "새 " + thread)]) == {2: 1, 3: 1}


def test_repeated_rows_edges(spark):
    assert repeats(spark, []) == {}
    long = sentence(random.Random(2), 3000)
    rows = [(1, 0, "a", "짧다"), (2, 0, "a", "짧다"), (3, 0, "b", "짧다"), (4, 1, None, long), (5, 1, None, long), (6, 1, "a", ""), (7, 1, "a", ""), (8, 2, "x", None), (9, 2, "a", "짧다"), (10, 2, "a", "다른 글")]
    assert repeats(spark, rows) == {2: 1, 5: 4, 9: 1}


def test_matches_within_a_batch_are_the_longest_of_earlier_lines():
    rng = np.random.default_rng(5)
    for n in (0, 1, 400):
        keys = np.array(["".join(rng.choice(list("ab"), 8)) for _ in range(n)], dtype="S8")
        lines, indexed = rng.integers(0, 60, n), rng.random(n) < 0.8
        order = np.lexsort((lines, keys))
        keys, lines, indexed = keys[order], lines[order], indexed[order]
        length, line = anchors.earlier_matches(keys, lines, indexed, 8, 3)
        for i in range(n):
            found = [(len(os.path.commonprefix([keys[i], keys[j]])), -int(lines[j])) for j in range(n) if indexed[j] and lines[j] < lines[i]]
            most = max((m for m, _ in found), default=0)
            assert length[i] == (most if most >= 3 else 0)
            # of equally long matches the earliest line of one of the nearest keys
            assert (line[i] == -1) if most < 3 else (most, -int(line[i])) in found


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "input_line long, batch_id int, observation_id string, text string, line string")


def test_near_copies_are_found_alike_in_one_call_and_over_several(spark):
    rng = random.Random(12)
    letter = lambda: chr(rng.randrange(0xAC00, 0xD7A4))
    old = ["".join(letter() for _ in range(150)) for _ in range(150)]
    new = ["".join(letter() if i % 25 == 12 else c for i, c in enumerate(t)) for t in old]
    rows = [(n + 1000 * k, k, f"{k}-{n}", t) for k, texts in enumerate((old, new)) for n, t in enumerate(texts)]
    want = {1000 + n: n for n in range(150)}
    at_once = repeats(spark, rows)
    state, over = None, {}
    for k in (0, 1):
        found, state = history.admit(frame(spark, [r for r in rows if r[1] == k]), state)
        over |= {r["line"]: r["repeated_line"] for r in found.collect()}
    assert at_once.items() <= want.items() and len(at_once) >= 148 and over == at_once


def test_batches_one_by_one_give_as_good_as_what_one_call_gives(spark):
    rng = random.Random(3)
    texts, rows = [sentence(rng, 16) for _ in range(25)], []
    for n in range(160):
        text = rng.choice(["짧은 글", None, ""]) if rng.random() < 0.2 else damage(rng, rng.choice(texts), rng.choice([0, 0.02, 0.05]))
        rows.append((n, n // 32, rng.choice([None, "id1", f"o{n}"]), text))
    want, state, got, levels = brute_repeats(rows), None, {}, []
    for k in range(5):
        found, state = history.admit(frame(spark, [r for r in rows if r[1] == k]), state)
        got |= {r["line"]: r["repeated_line"] for r in found.collect()}
        levels.append(sorted(p["level"] for p in history.State(spark, state).parts if p["kind"] == "array"))
    at_once = repeats(spark, rows)
    # a place votes for one line only, so a rare match may show up on one way and not on the other
    assert sum(got.get(k) != at_once.get(k) for k in {*got, *at_once}) <= 2 and sum(got.get(k) != want.get(k) for k in {*got, *want}) <= 2 and len(want) > 100
    assert levels == [[0], [1], [0, 1], [2], [0, 2]]  # two arrays of one level become one of the next
    assert {r["line"]: r["repeated_line"] for r in history.admit(frame(spark, rows), save=False, exact=True)[0].collect()} == want  # the exact way
    # rejected rows leave no text behind, accepted ones do, once
    kept = [r["line"] for r in history.State(spark, state).table("texts").collect()]
    assert len(kept) == len(set(kept)) and not set(kept) & set(got)


def test_a_batch_reads_arrays_classes_and_texts_but_no_earlier_rows(spark):
    rng = random.Random(4)
    old = [(n, 0, None, sentence(rng, 20)) for n in range(40)]
    _, state = history.admit(frame(spark, old))
    spark.catalog.clearCache()
    new = [(100 + n, 1, None, damage(rng, old[n][3], 0.04)) for n in range(0, 40, 3)] + [(500, 1, None, old[7][3])]
    found, later = history.admit(frame(spark, new), state)
    assert {r["line"]: r["repeated_line"] for r in found.collect()} == {100 + n: n for n in range(0, 40, 3)} | {500: 7}
    # the old state is unchanged and still answers
    assert {r["line"] for r in history.admit(frame(spark, new[:1]), state, save=False)[0].collect()} == {100} and later != state
    assert history.admit(frame(spark, []), state)[0].count() == 0


def test_hot_phrases_are_spread_over_shards(spark):
    rng = random.Random(9)
    rows = [(n, "같은머리말이언제나앞에서는글" + letters(sentence(rng, 12))) for n in range(120)]
    df = spark.createDataFrame(rows, "line long, letters string")
    bounds = history.ranges(df, 8)
    n = Counter()
    for r in history.entries(df, bounds).collect():
        n[r["shard"]] += len(history._u(r["e"], "u1")) if r["kind"] == history.NEW else 0
    assert len(bounds) == 7 and max(n.values()) <= 0.3 * sum(n.values())


@needs_data
def test_repeated_rows_on_the_test_table(spark):
    rows = [(r["input_line"], r["batch_id"], r["observation_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/observations.parquet").collect()]
    assert repeats(spark, rows) == brute_repeats(rows)


def test_overlaps_match_brute_force(spark):
    rng = random.Random(4)
    rows, texts = [], [sentence(rng, 14) for _ in range(12)]
    for n in range(220):
        pick = lambda: None if rng.random() < 0.1 else damage(rng, rng.choice(texts), rng.choice([0, 0.03, 0.06])) if rng.random() < 0.5 else sentence(rng, rng.randrange(1, 25))  # noqa: E731,B023
        rows.append((f"e{n:03}", rng.choice(["train", "Training ", "val", "TEST", "dev", None, "other"]), "src", pick(), pick(), "clash"))
    rows.append(rows[0])
    df = spark.createDataFrame(rows, "id string, split string, source string, brief string, target string, letters string")
    side = {"train": "train", "Training ": "train", "val": "dev", "TEST": "test", "dev": "dev"}
    want = set()
    for a in rows:
        for b in rows:
            if side.get(a[1]) == "train" and side.get(b[1]) in ("dev", "test"):
                for k in (3, 4):
                    x, y = letters(a[k] or ""), letters(b[k] or "")
                    if min(len(x), len(y)) >= 45 and within(x, y, overlap.DIFFER):
                        want.add((min(a[0], b[0]), max(a[0], b[0])))
    got = {tuple(r) for r in overlap.overlap_pairs(df, "id", "split", "source", ["brief", "target"]).collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want) > 20, len(got) / len(want)
    assert {tuple(r) for r in overlap.overlap_pairs(df, "id", "split", "source", ["brief", "target"], exact=True).collect()} == want
    report = overlap.overlap_report(df, "id", "split", "source", ["brief", "target"]).collect()
    assert {r["split"] for r in report} <= {"dev", "test"} and all(r["evaluation_rows"] <= r["pairs"] for r in report)
    assert overlap.overlap_pairs(df.where("false"), "id", "split", "source", ["brief"]).count() == 0


def test_outer_spaces_of_a_split_are_of_any_kind(spark):
    rng = random.Random(14)
    texts = [sentence(rng, 14) for _ in range(8)]
    outer = ["", " ", "\t", "\n", "\u00a0", "\u3000", "\u2003 ", "\ufeff\u200b"]
    rows = [(f"a{k}", x + "Train" + y, t) for k, (t, x, y) in enumerate(zip(texts, outer, outer[::-1]))]
    rows += [(f"b{k}", y + "VALID" + x, damage(rng, t, 0.04)) for k, (t, x, y) in enumerate(zip(texts, outer, outer[3:] + outer[:3]))]
    rows += [("c0", "tra in", texts[0]), ("c1", "\u3000", texts[1]), ("c2", None, texts[2])]
    df = spark.createDataFrame([(i, s, "src", t) for i, s, t in rows], "id string, split string, source string, brief string")
    got = {tuple(r) for r in overlap.overlap_pairs(df, "id", "split", "source", ["brief"]).collect()}
    assert got == {(f"a{k}", f"b{k}") for k in range(8)}


def test_groups_match_union_find(spark):
    rng = random.Random(5)
    rows = [(f"m{rng.randrange(80):02}", rng.choice([None, "-", "N/A", " unknown", "", "hot", f"F{rng.randrange(30)}", f" f{rng.randrange(30)}\t"]), [rng.choice([None, "-", f"g{rng.randrange(60)}"])] * rng.randrange(2)) for _ in range(150)]
    rows += [(None, "hot", []), ("alone", None, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for m, f, g in rows:
        if m is None:
            continue
        find("0" + m)
        for kind, v in [("f", f), *[("g", x) for x in g or []]]:
            if v is not None and v.strip().lower() not in ("", "-", "n/a", "unknown"):
                a, b = find("0" + m), find(kind + v.strip().lower())
                parent[max(a, b)] = min(a, b)
    want = {x[1:]: find(x)[1:] for x in list(parent) if x[0] == "0"}
    df = spark.createDataFrame(rows, "meme_id string, family_id string, g array<string>")
    got = {r["entity"]: r["group"] for r in groups.tied(df, "meme_id", ["family_id"], [F.col("g")]).collect()}
    assert got == want
    split = {r["entity"]: (r["group"], r["split"]) for r in groups.assign(spark.createDataFrame(list(want.items()), "entity string, group string"), [("train", 0.7), ("dev", 0.3)]).collect()}
    assert set(split) == set(want) and len({(g, s) for g, s in split.values()}) == len(set(want.values()))
    assert groups.tied(df.where("false"), "meme_id", ["family_id"]).count() == 0


def test_components_beyond_one_task_use_stars(spark):
    rng = random.Random(6)
    edges = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(250)] + [("n000", f"n{i:03}") for i in range(0, 100)]
    df = spark.createDataFrame(edges, "a string, b string").repartition(6)
    a = {r["node"]: r["root"] for r in groups.components(df, 20).collect()}
    b = {r["node"]: r["root"] for r in groups.components(df).collect()}
    assert a == b


def test_allot_is_greedy():
    rng = random.Random(7)
    for _ in range(200):
        sizes = dict(Counter(rng.choice([1, 1, 1, 2, 3, 5, 20]) for _ in range(rng.randrange(1, 60))))
        total = sum(s * n for s, n in sizes.items())
        targets = [total * f for f in (0.72, 0.15, 0.13)]
        gaps, want = list(targets), defaultdict(lambda: [0, 0, 0])
        for s in sorted(sizes, reverse=True):
            for _ in range(sizes[s]):
                i = max(range(3), key=lambda k: (gaps[k], -k))
                gaps[i] -= s
                want[s][i] += 1
        got = groups.allot(sizes, targets)
        end = [t - sum(s * got[s][i] for s in got) for i, t in enumerate(targets)]
        assert all(sum(got[s]) == sizes[s] for s in sizes) and max(abs(x - y) for x, y in zip(sorted(end), sorted(gaps))) < 1e-6


def test_plan_fills_containers():
    rng = random.Random(8)
    for _ in range(100):
        cap = rng.randrange(1, 60)
        counts = dict(Counter(rng.randrange(1, cap + 1) for _ in range(rng.randrange(1, 200))))
        room, placed = defaultdict(int), Counter()
        for s, first, container, n, times in pack.plan(counts, cap):
            assert first == placed[s]
            placed[s] += n * times
            for k in range(times):
                room[container + k] += n * s
        assert placed == Counter(counts) and max(room.values()) <= cap and sorted(room) == list(range(len(room)))
        assert len(room) <= 1.25 * -(-sum(s * n for s, n in counts.items()) // cap) + 1 or cap < 8


def test_pack_keeps_every_token(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice([0, None, 1, 7, 7, 7, 30, 65, 200]), "x") for i in range(300)] + [(1, 7, "x")]
    got = pack.pack(spark.createDataFrame(rows, "id long, size int, container string").select("id", "size"), [64, 16, 64]).collect()
    for cap in (16, 64):
        mine = [r for r in got if r["capacity"] == cap]
        total, load = Counter(), Counter()
        for r in mine:
            total[r["id"]] += r["size"]
            if r["container"] is None:
                assert r["size"] == 0
            else:
                load[r["container"]] += r["size"]
        want = Counter()
        for i, s, _ in rows:
            want[i] += s or 0
        assert +total == +want and {r["id"] for r in mine} == {i for i, _, _ in rows} and max(load.values()) <= cap
        assert len({(r["id"], r["piece"]) for r in mine if r["size"] and r["id"] != 1}) == sum(-(-(s or 0) // cap) for i, s, _ in rows if i != 1)
    assert pack.pack(spark.createDataFrame([], "id long, size int"), [8]).count() == 0
