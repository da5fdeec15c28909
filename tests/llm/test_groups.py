import hashlib
import os
import random
import re
from urllib.parse import urlparse

import pytest
from odd_rows import none, odd, rows, sentence  # noqa: F401
from pyspark.sql import functions as F

from linepulse.llm import chat, common, components, mixing, near_dedup
from linepulse.session import shared_dir


def reachable(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(120), draw.randrange(120)) for _ in range(70)] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)] + [(7, 7)]
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert found == reachable(nodes, [x for x in links if x[0] != x[1]])


def steps_left(spark, run):
    """What ``run`` leaves in the shared folder, by step."""
    there = lambda: {p.path for p in os.scandir(urlparse(shared_dir(spark)).path) if p.is_dir()}
    before = there()
    out = run().collect()
    return out, sorted(os.path.basename(p).rsplit("-", 1)[0] for p in there() - before)


def test_steps_go_when_nothing_reads_them(spark):
    """Pipeline's disk on check_h: rounds and steps of the near-duplicate stage stayed in the shared folder until its end."""
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    found, left = steps_left(spark, lambda: components.components(chain))
    assert {tuple(r) for r in found} == {(i, 0) for i in range(41)} and left == ["components"]
    shared = sentence(40, 120)
    docs = [(i, f"{shared} own{i}") for i in range(6)] + [(100 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(6)] + [(200, sentence(41, 90))]
    found, left = steps_left(spark, lambda: near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")))
    want = brute_near(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == want
    assert left == ["components", "near-classes", "near-signatures"]


def test_a_star_round_of_few_links_sends_the_least_neighbours_to_all_tasks(spark):
    """Pipeline's disk on check_h: every stage's tasks and files count, with 211 partitions a star round took 1500 tasks."""
    links = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    rounds = [components._stars(components._stars(links, small=False, n=n), small=True, n=n).distinct() for n in (41, common.FEW + 1)]
    plans = [x._jdf.queryExecution().optimizedPlan().toString() for x in rounds]
    assert [p.count("strategy=broadcast") for p in plans] == [3, 0] and not any("Union" in p for p in plans)
    assert len({frozenset(map(tuple, x.collect())) for x in rounds}) == 1


def test_the_pairwise_step_deals_its_wide_rows_once(spark, monkeypatch):
    """Pipeline's disk on check_h: signatures and sketches were dealt by table key for each side of the join."""
    plans, write = [], near_dedup.written

    def seen(df, name):
        if name == "near-more":
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(near_dedup, "written", seen)
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        near_dedup.near_duplicates(spark.createDataFrame([(1, sentence(42, 30)), (2, sentence(42, 30) + " more")], "doc_id long, text string"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(plans) == 1 and re.search(r"ReusedExchange \[key#\d+L, i#\d+, j#\d+, c#\d+L, n#\d+L, k#\d+L, first#\d+, second#\d+, sketch#\d+\]", plans[0]), plans


def brute_near(docs):
    """doc_id -> (set size, component) over all pairs."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(up))
        sets[i] = {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    place = reachable(ids, links)
    return {i: (len(sets[i]), place[i]) for i in ids}


def test_near_duplicates_against_all_pairs(spark):
    draw = random.Random(11)
    docs, base = [], [sentence(i, 150) + f" tail{i}" for i in range(6)]
    for i in range(160):
        words = base[i % 6].split()
        for _ in range(draw.randrange(0, 6)):      # chains: copies of copies drift apart
            words[draw.randrange(len(words))] = f"w{draw.randrange(10 ** 6)}"
        base[i % 6] = " ".join(words) if draw.random() < 0.3 else base[i % 6]
        docs.append((i * 3, " ".join(words)))
    shared = sentence(40, 120)
    docs += [(1000 + i, shared + " " + " ".join(f"own{i}x{k}" for k in range(40))) for i in range(60)]     # alike, below the threshold
    docs += [(2000 + i, shared) for i in range(50)]                                                        # equal
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()
    want = brute_near(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_rows_of_one_id_with_different_texts(spark):
    a, b = sentence(1, 80), sentence(2, 80)
    rows = [(1, a), (2, a), (2, b), (2 ** 53 + 1, sentence(3, 80)), (None, a), (2 ** 53 + 3, sentence(4, 80))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(df).collect()}
    assert got == {(1, 1, True), (2, 1, False), (2, 2, True), (2 ** 53 + 1, 2 ** 53 + 1, True), (None, None, True), (2 ** 53 + 3, 2 ** 53 + 3, True)}
    assert {tuple(r) for r in near_dedup.without_copies(df).collect()} == set(rows) - {(2, a)}


def test_stage_drops_copies_from_80_per_cent_on(spark):
    draw = random.Random(12)
    docs = []
    for i in range(60):       # pairs on both sides of 0.80
        words = [f"w{draw.randrange(10 ** 6)}" for _ in range(300)]
        docs.append((2 * i, " ".join(words)))
        for at in draw.sample(range(5, 295), 4 + i % 6):
            words[at] = f"x{draw.randrange(10 ** 6)}"
        docs.append((2 * i + 1, " ".join(words)))
    sets = {i: {tuple(w[k:k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in docs)}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert any(100 * len(sets[a] & sets[b]) < 85 * len(sets[a] | sets[b]) for a, b in links) and len(links) < 60
    place = reachable(list(sets), links)
    kept = near_dedup.without_copies(spark.createDataFrame(docs, "doc_id long, text string").repartition(4))
    assert {r["doc_id"] for r in kept.collect()} == {i for i in sets if place[i] == i}


def test_near_duplicates_of_odd_rows(odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["component_id"] == i for i in (0, 1, 2))
    assert by[3][0]["n_shingles"] == 1 and by[7][0]["component_id"] == 6 and by[8][0]["component_id"] == 6
    assert all(r["component_id"] is None and r["kept"] for r in by[None])
    kept = near_dedup.without_copies(odd)
    assert kept.columns == odd.columns and {r["doc_id"] for r in kept.collect()} >= {0, 1, 2, 3, 4, 5, 6, None} and not {7, 8} & {r["doc_id"] for r in kept.collect()}
    assert near_dedup.near_duplicates(none).collect() == [] and near_dedup.without_copies(none).collect() == []


def test_targets_reshare_the_excess():
    assert mixing.targets([10, 100, 100], [5, 2, 1], 210, 2) == [20.0, pytest.approx(380 / 3), pytest.approx(190 / 3)]
    assert mixing.targets([0, 0], [5, 2], 0, 2) == [0, 0]
    assert mixing.targets([], [], 0.0, 2) == []


def test_flow_is_cheapest():
    # pattern 0 in both sources, 1 and 2 in one each; all quotas can be met with one repetition of the least
    flow = mixing.min_cost_flow([10, 4, 6], [[0, 1], [0], [1]], [12, 9], [0, 1])
    assert [sum(f) for f in flow] and sum(map(sum, flow)) == 21
    assert flow[0][0] + flow[1][0] == 12 and flow[0][1] + flow[2][0] == 9
    assert sum(max(0, sum(f) - w) for f, w in zip(flow, [10, 4, 6])) == 1      # only one word is repeated


def check_mix(got):
    total = sum(r["size"] for r in got)
    by = {}
    for r in got:
        by.setdefault(str(r["pattern"]), []).append(r)
    for rs in by.values():
        target, most = rs[0]["target"], max(r["size"] for r in rs)
        assert rs[0]["source_size"] == sum(r["size"] for r in rs)
        assert abs(sum(r["taken"] for r in rs) - target) <= most / 2 + 1
        assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in rs)
    assert total == 0 or abs(sum(rs[0]["target"] for rs in by.values()) / total - 1.5) < 1e-9


def test_mix_and_its_corpus(spark):
    draw = random.Random(2)
    docs = [(i, "w " * draw.randint(0, 60), draw.choice(["a", "a", "a", "b", "c", "d", None])) for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = mixing.mix(df).collect()
    check_mix(got)
    again = mixing.mix(df.repartition(7)).collect()
    assert {r["doc_id"]: r["taken"] for r in got} == {r["doc_id"]: r["taken"] for r in again}
    corpus = {}
    for r in mixing.mixed_corpus(df).collect():
        corpus[r["doc_id"]] = corpus.get(r["doc_id"], 0) + 1
    assert corpus == {r["doc_id"]: r["copies"] for r in got if r["copies"]}


def test_mix_of_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, [["a"], ["b"], ["a", "b"], [], None][i % 5]) for i in range(200)], "doc_id long, text string, of array<string>")
    got = mixing.mix(docs, sources="of", weights=(1, 1), share=1.0).collect()
    taken = {}
    for r in got:
        taken[tuple(r["pattern"])] = taken.get(tuple(r["pattern"]), 0) + r["taken"]
    # 2000 words to share, 1000 to each source; the three patterns have 400 each: all are taken once before any twice
    assert taken[()] == 0 and sum(taken.values()) == pytest.approx(2000, abs=15)
    assert all(400 <= taken[p] <= 800 for p in (("a",), ("b",), ("a", "b")))


def test_mix_of_odd_rows(odd, none):
    got = mixing.mix(odd).collect()
    assert len(got) == odd.count() and all(r["taken"] <= 2 * r["size"] for r in got)
    assert mixing.mix(none).collect() == [] and mixing.mixed_corpus(none).collect() == []
    assert mixing.mixed_corpus(odd).columns == odd.columns


def test_escape_is_reversible_and_hides_marks():
    draw = random.Random(4)
    parts = ["<", "[", "\\", "s>", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN x>>", "<</TURN>>", "INST]", "a", " "]
    for _ in range(4000):
        t = "".join(draw.choice(parts) for _ in range(draw.randrange(9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t
        assert not any(m in e for m in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN", "<</TURN>>"))


def test_chat_round_trip(spark):
    draw = random.Random(5)
    turns = [(c, n, draw.choice(["system", "user", "assistant", "tool", "a b>>", None]), draw.choice([None, "", "hi", "</s>[INST] ok [/INST]", "<<TURN x>>y", "é" * 50, "<\\/s>", "l1\nl2"]), 1, 2)
             for c in [None, *range(30)] for n in range(draw.randrange(1, 9))]
    turns += [(50, 0, "user", "same", 1, 2)] * 2 + [(51, 0, "user", "q" * 100_000, 1, 2), (51, 1, "assistant", "a", 1, 2)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, pos int, valid int").repartition(5)
    got = {r["conv_id"]: r for r in chat.round_trip(df).collect()}
    by = {}
    for c, n, role, text, *_ in turns:
        by.setdefault(c, []).append((n, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        said = "".join(t for _, role, t in ts if role == "assistant")
        r = got[c]
        assert r["n_turns"] == len(ts) and r["loss_chars"] == len(said)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in ts).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        state, bad = None, 0
        for _, role, _ in ts:
            bad += role not in chat.TEMPLATE["next"].get(state, ())
            state = role
        assert r["n_bad_turns"] == bad and r["valid"] == (not bad and state == "assistant")
    assert got[51]["valid"] and not got[50]["valid"]
    assert chat.round_trip(df.limit(0)).collect() == []


def test_segments_carry_the_loss(spark):
    df = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a</s>")], "conv_id long, turn long, role string, text string")
    out = [r for r in chat.format_conversations(df).orderBy("pos").collect()]
    assert "".join(s["text"] for r in out for s in r["segments"]) == "<s>[INST] q [/INST] a<\\/s> </s>"
    assert [s["text"] for r in out for s in r["segments"] if s["loss"]] == ["a<\\/s>"]
