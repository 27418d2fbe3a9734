"""Votes, near duplicates, packing and leaks against brute force on small fixtures."""

import datetime as dt
import random
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest

from giurispark.llm import leaks, neardup, packing, pairs, queries, votes
from giurispark.llm.forms import words

T0 = dt.datetime(2024, 1, 1)
VOTES = "item long, judge_id string, model string, verdict string, status string, voted_at timestamp_ntz"
RND = random.Random(5)
VOCABULARY = [f"parola{i}" for i in range(400)]


def text(n, rnd=RND):
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


# ---- votes -------------------------------------------------------------------------------


def test_counting_takes_the_latest_valid_vote(spark):
    rows = [(1, " a", "m", "PASS\n", "ok", T0), (1, "A", "m", "fail", "ok", T0 + dt.timedelta(1)), (1, "A", "m", "pass", "error", T0 + dt.timedelta(2)), (1, "A", "m", "incerto", "ok", T0 + dt.timedelta(3)), (1, "A", "m", "fail", "ok", T0 + dt.timedelta(1)), (1, None, "m", "pass", "ok", T0), (1, "b", "m", "pass ", "ok", None)]
    got = votes.counting(spark.createDataFrame(rows, VOTES), ["item"]).collect()
    assert {(r.judge, r.verdict) for r in got} == {("A", "fail"), ("B", "pass")}


def test_reliability_orders_judges_and_consensus_follows(spark):
    rnd, rows, truth = random.Random(1), [], {}
    for i in range(400):
        truth[i] = rnd.choice(("pass", "fail"))
        for judge, accuracy in (("A", 0.95), ("B", 0.85), ("C", 0.6)):
            right = rnd.random() < accuracy
            rows.append((i, judge, "m", truth[i] if right else ("fail" if truth[i] == "pass" else "pass"), "ok", T0))
    items = votes.by_item(votes.counting(spark.createDataFrame(rows, VOTES), ["item"]), ["item"])
    table = votes.patterns(items)
    raters = {r.judge: r.accuracy for r in votes.reliability(table).collect()}
    # of three judges the two better ones mirror each other: each one's fellows follow the other
    assert min(raters["A"], raters["B"]) > raters["C"] + 0.05
    got = votes.consensus(items, table, votes.reliability(table)).collect()
    assert sum(r.leaning == truth[r.item] for r in got) / len(got) > 0.86
    assert all(r.consensus == ("pass" if r.n_pass >= 2 else "fail") for r in got)


def test_alpha_by_hand_and_empty(spark):
    rows = [(1, "A", "m", "pass", "ok", T0), (1, "B", "m", "pass", "ok", T0), (2, "A", "m", "fail", "ok", T0), (2, "B", "m", "fail", "ok", T0), (3, "A", "m", "pass", "ok", T0), (3, "B", "m", "fail", "ok", T0), (4, "A", "m", "pass", "ok", T0)]
    r = votes.alpha(votes.patterns(votes.by_item(votes.counting(spark.createDataFrame(rows, VOTES), ["item"]), ["item"]))).first()
    # coincidences: pp 2, ff 2, pf + fp 2; observed 2/6, expected 2*3*3/(6*5)
    assert (r["items"], r["votes"], r["alpha"]) == (3, 6, round(1 - (2 / 6) / (18 / 30), 6))
    empty = votes.alpha(votes.patterns(votes.by_item(votes.counting(spark.createDataFrame([], VOTES), ["item"]), ["item"]))).first()
    assert empty["alpha"] is None and empty["items"] == 0
    assert votes.reliability(votes.patterns(votes.by_item(votes.counting(spark.createDataFrame([], VOTES), ["item"]), ["item"]))).count() == 0


# ---- near duplicates -----------------------------------------------------------------------


def sets(rows):
    out = {}
    for i, t in rows:
        w = words(t or "")
        if len(w) >= 3:
            out[i] = set(zip(w, w[1:], w[2:]))
    return out


def test_near_duplicates_against_brute_force(spark):
    rows = []
    for group in range(25):
        base = text(120).split()
        rows.append((len(rows), " ".join(base)))
        for edits in (0, 2, 6):
            own = list(base)
            for _ in range(edits):
                own[RND.randrange(len(own))] = RND.choice(VOCABULARY)
            rows.append((len(rows), " ".join(own) if edits else " ".join(own).upper().replace("A", "À")))
    rows += [(900, None), (901, ""), (902, "due parole"), (903, text(3000)), (904, "uno due tre"), (905, "Uno, due: tre!")]
    df = spark.createDataFrame([(i, t, "extra") for i, t in rows], "id long, text string, cls string")
    table = neardup.features(df)
    members, links = neardup.classes(table), neardup.class_pairs(table, block=3)
    got = {(r.a, r.b) for r in neardup.record_pairs(members, links).collect()}
    s = sets(rows)
    want = {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= 0.6}
    assert got == want and (904, 905) in want
    groups = {r.id: r.component for r in neardup.components(members.where("id = rep").select("id"), links).collect()}
    reps = {r.id: r.rep for r in members.collect()}
    assert all(groups[reps[a]] == groups[reps[b]] for a, b in want)
    assert set(reps) == set(s)


def test_groups_have_a_row_for_every_record(spark, tmp_path):
    rows = [(1, "uno due tre quattro", None), (2, "Uno due tre", ["quattro"]), (3, None, None), (4, "", []), (5, "due parole", None), (6, "altro testo del tutto", None)]
    spark.createDataFrame(rows, "prov_id long, facts string, principles array<string>").write.parquet(f"{tmp_path}/provvedimenti.parquet")
    got = sorted(tuple(r) for r in queries.p5_groups(spark, str(tmp_path)).collect())
    assert got == [(1, 1, 1, 0), (2, 1, 1, 0), *[(i, i, i, 0) for i in (3, 4, 5, 6)]]


def test_components_of_long_chains(spark):
    n = 300
    ids = random.Random(3).sample(range(10_000), n)
    chain = list(zip(ids, ids[1:])) + [(20_000 + i, 20_000 + (i + 1) % n) for i in range(1, n)] + [(40_000, 40_001), (40_001, 40_000)]
    nodes = sorted({x for e in chain for x in e} | {50_000})
    got = {r.id: r.component for r in neardup.components(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: min(ids) if i < 10_000 else 20_000 if i < 40_000 else 40_000 if i < 50_000 else 50_000 for i in nodes}
    with pytest.raises(RuntimeError):
        neardup.components(spark.createDataFrame([(i,) for i in nodes], "id long"), spark.createDataFrame(chain, "a long, b long"), rounds=2)


def test_near_duplicates_of_nothing(spark):
    table = neardup.features(spark.createDataFrame([], "id long, text string"))
    assert table.count() == 0 and neardup.class_pairs(table).count() == 0


def test_near_duplicates_leave_little_on_disk(spark):
    dirs = [str(d) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    used = lambda: sum(p.stat().st_size for d in dirs for p in Path(d).rglob("shuffle_*"))
    n, before = 2000, used()
    df = spark.createDataFrame([(i, text(60)) for i in range(n)], "id long, text string")
    neardup.class_pairs(neardup.features(df)).count()
    assert used() - before < 400 * n  # a key of every segment, eight bytes each, is more


def test_sets_made_again_give_the_same_pairs(spark):
    base = [text(80).split() for _ in range(40)]
    rows = [(10 * i + k, " ".join(b[k:])) for i, b in enumerate(base) for k in (0, 0, 3, 20, 50)] + [(1000, None), (-5, " ".join(base[0]))]
    rows = list(dict(rows).items())
    df = spark.createDataFrame(rows, "id int, text string")
    want = sorted(tuple(r) for r in neardup.class_pairs(neardup.features(df)).collect())
    table = neardup.features(df, sets=False)
    assert "set" not in table.columns
    assert sorted(tuple(r) for r in neardup.class_pairs(table, block=2, texts=df).collect()) == want
    s = sets(rows)
    assert len(want) > 40 and all(abs(j - len(s[a] & s[b]) / len(s[a] | s[b])) < 1e-9 for a, b, j, _ in want)


def test_fingerprint_distance_follows_similarity():
    a = neardup.shingles(text(400).split())
    b = np.unique(np.concatenate([a[: int(len(a) * 0.75)], neardup.shingles(text(100).split())]))
    j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((neardup.fingerprint(a) == neardup.fingerprint(b)).mean() - j) < 0.2


# ---- packing -------------------------------------------------------------------------------


def test_packing_is_whole_and_within_capacity(spark):
    rows = [(i, text(RND.choice((5, 40, 200))), 0) for i in range(300)] + [(1000, None, 0), (1001, "", 0), (1002, text(3000), 0)] + [(2000 + i, "testo uguale per tutti", 0) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tokens int")
    got = packing.packed(df, capacity=512).collect()
    encode = packing.tokenizer(packing.VOCABULARY)
    size = {i: len(encode.encode_ordinary(t or "")) for i, t, _ in rows}
    by_doc, by_box = {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_box[r.container] = by_box.get(r.container, 0) + r.tokens
    assert {k: sum(r.tokens for r in v) for k, v in by_doc.items()} == size
    assert all(len(v) == 1 or size[k] > 512 for k, v in by_doc.items())
    assert all(sorted(r.piece for r in v) == list(range(v[0].pieces)) for v in by_doc.values())
    assert max(by_box.values()) <= 512 and 1 - sum(size.values()) / (512 * len(by_box)) < 0.1
    assert packing.packed(df.limit(0)).count() == 0


def test_hilbert_curve_is_a_path():
    grid = np.array([(x, y) for x in range(16) for y in range(16)])
    key = packing.hilbert(grid, 4)
    assert sorted(key) == list(range(256))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# ---- leaks ---------------------------------------------------------------------------------


def test_leaks_against_brute_force(spark):
    items = [(i, text(n)) for i, n in enumerate((12, 20, 40, 11, 60))] + [(8, None), (9, "")]
    docs = []
    for d in range(60):
        own = text(80).split()
        if d % 3 == 0:
            source = items[d % 5][1].split()
            n = RND.choice((11, 12, 20))
            own[30:30] = source[:n]
        docs.append((d, ", ".join(own).title() if d % 2 else " ".join(own)))
    docs += [(100, None), (101, ""), (102, items[4][1].upper()), (103, text(30_000) + " " + items[2][1])]
    df, held = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(df, held).where("exact > 0").collect()}
    want = set()
    for d, t in docs:
        w = words(t or "")
        runs = {tuple(w[k : k + 12]) for k in range(len(w) - 11)}
        want |= {(d, i) for i, s in items for v in [words(s or "")] if any(tuple(v[k : k + 12]) in runs for k in range(len(v) - 11))}
    assert got == want and (103, 2) in want
    parts = {(r.doc_id, r.item_id) for r in leaks.leaked(df, held, part=30).where("exact > 0").collect()}
    assert parts == want
    assert leaks.leaked(df, held.limit(0)).count() == 0 and leaks.leaked(df.limit(0), held).count() == 0


def test_near_windows_against_brute_force(spark):
    rnd = random.Random(8)
    short = [f"{a}{b}" for a in "xyz" for b in ("", "a", "bcdefghi")]  # repeated pairs and unequal weights
    items = [(0, text(40, rnd)), (1, text(25, rnd)), (2, " ".join(rnd.choice(short) for _ in range(40))), (3, "x y " * 9)]
    docs = []
    for d in range(60):
        own, source = text(30, rnd).split(), items[d % 3][1].split()
        at = rnd.randrange(len(source) - 12)
        piece = source[at : at + 12]
        piece[(0, 11, rnd.randrange(12))[d // 3 % 3]] = "altra"
        docs.append((d, " ".join(own[:15] + piece + own[15:])))
    docs += [(100, items[2][1]), (101, "y x " * 9), (102, " ".join(rnd.choice(short) for _ in range(400)))]
    want = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v = words(s)
            pairs_ = [(a == b, leaks.similarity(a, b), k) for k in range(len(w) - 11) for j in range(len(v) - 11) for a, b in [(tuple(w[k : k + 12]), tuple(v[j : j + 12]))]]
            if hits := [p for p in pairs_ if p[1] >= 0.8]:
                want[d, i] = (sum(p[0] for p in hits), sum(not p[0] for p in hits), max(p[1] for p in hits), min(p[2] for p in hits))
    df, held = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.exact, r.near, r.best, r.first_word) for r in leaks.leaked(df, held).collect()}
    assert got == want and sum(w[0] == 0 for w in want.values()) >= 30
    equal = {(r.doc_id, r.item_id): r.exact for r in leaks.leaked(df, held, near=False).collect()}
    assert equal == {k: w[0] for k, w in want.items() if w[0]}


def test_blocks_find_every_fingerprint_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, 300, dtype=np.uint64)
    q = leaks.Queries(np.arange(300), prints, [], 12, 3)
    near = prints.copy()
    for i in range(300):
        for bit in rng.choice(64, i % 5, replace=False):
            near[i] ^= np.uint64(1) << np.uint64(bit)
    window, query = q.within(near)
    want = {(i, j) for i in range(300) for j in np.flatnonzero(np.bitwise_count(near[i] ^ prints) <= 3)}
    assert set(zip(window.tolist(), query.tolist())) == want


def test_reliability_by_joins_equals_reliability_in_memory(spark):
    rnd, rows = random.Random(3), []
    for i in range(60):
        truth = rnd.random() < 0.6
        votes_ = {j: truth if rnd.random() < a else not truth for j, a in (("A", 0.9), ("B", 0.8))}
        if votes_["A"] != votes_["B"]:  # the third is only asked where two disagree
            votes_["C"] = truth if rnd.random() < 0.85 else not truth
        rows += [(i, j, "m", "pass" if v else "fail", "ok", T0) for j, v in votes_.items()]
    rows.append((99, "A", None, "pass", "ok", T0))
    table = votes.patterns(votes.by_item(votes.counting(spark.createDataFrame(rows, VOTES), ["item"]), ["item"]))
    a, b = ({(r.judge, r.model): (r.n_votes, round(r.compared, 6), round(r.accuracy, 6)) for r in votes.reliability(table, tolerance=0.02, small=n).collect()} for n in (1000, 0))
    assert a == b and a[("A", None)] == (1, 0.0, 0.75)
    with pytest.raises(RuntimeError):
        votes.reliability(table, tolerance=0.0, rounds=2)


def test_containers_do_not_depend_on_partitions(spark):
    rows = [(i, f"testo numero {i} " * (1 + i * 37 % 90)) for i in range(300)] + [(1000, None), (1001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two = ({tuple(r) for r in packing.packed(docs.repartition(n)).collect()} for n in (1, 7))
    assert one == two and {r[0] for r in one} == {r[0] for r in rows}


def test_tiles_by_grams_cover_what_greedy_tiles_cover():
    rnd = random.Random(5)
    for _ in range(200):
        q = "".join(rnd.choice("abc") for _ in range(60))
        a = "".join(q[i : i + rnd.randint(3, 30)] if rnd.random() < 0.6 else rnd.choice("xyz") for i in (rnd.randrange(40) for _ in range(12)))
        marks = pairs.covered(a, np.unique(pairs.grams(q)))
        greedy = np.zeros(len(a), bool)
        for lo, hi in pairs.tiles(a, q):
            greedy[lo:hi] = True
        assert (greedy <= marks).all()  # tiles that others overlap are cut short
        assert all(any(a[i : i + pairs.TILE] in q for i in range(max(0, p - pairs.TILE + 1), p + 1)) for p in np.flatnonzero(marks))


def test_batch_of_sets_equals_single_sets():
    texts = [["a"] * n + [str(k) for k in range(n * 7 % 11)] for n in (0, 1, 2, 3, 9, 40)]
    owner, s = neardup.all_shingles(texts)
    for k, t in enumerate(texts):
        assert (s[owner == k] == neardup.shingles(t)).all()
    rows, starts = np.unique(owner, return_index=True)
    assert (neardup.fingerprints(s, starts) == np.stack([neardup.fingerprint(s[owner == r]) for r in rows])).all()
